"""Listings in, clean enriched leads out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform import fixed
from entiform.functions.phone import PLANS
from entiform.operators.chains import detect_chains
from entiform.operators.dedup import dedup_entities
from entiform.operators.leads import flatten_leads, normalize_leads, parse_places, validate_leads
from entiform.operators.lookups import union_restored
from entiform.plans.stages import Stage, run_stages


def places_to_leads(places: DataFrame, country: str = fixed.DEFAULT_COUNTRY, fallback_city: Column | None = None,
                    plans=PLANS) -> tuple[DataFrame, DataFrame]:
    """(valid leads, rejects) from listing strings."""
    return validate_leads(normalize_leads(parse_places(places, country, fallback_city), country, plans=plans))


def collect_leads(places: DataFrame, country: str = fixed.DEFAULT_COUNTRY, fallback_city: Column | None = None,
                  plans=PLANS) -> DataFrame:
    """Accepted leads from listing strings."""
    return dedup_entities(places_to_leads(places, country, fallback_city, plans)[0])


def finish_leads(leads: DataFrame, stages: Iterable[Stage] = (), tables: Mapping[str, DataFrame] | None = None,
                 restored: DataFrame | None = None) -> DataFrame:
    """Enrichment of leads not attempted before, then chains over all leads.

    `restored` holds the leads of an earlier, interrupted run; finished ones are kept as they are.
    """
    stages = list(stages)
    if restored is not None:
        leads = union_restored(restored, leads).drop("export_rank")
    if stages:
        attempted = F.coalesce("enrich_attempted", F.lit(False))
        done = leads.filter(attempted)
        leads = done.unionByName(run_stages(leads.filter(~attempted), stages, tables or {}))
    return detect_chains(leads)


def lead_delivery(places: DataFrame, country: str = fixed.DEFAULT_COUNTRY) -> DataFrame:
    """Listings to the delivery table: parse, normalise, validate, deduplicate, find chains, flatten."""
    return flatten_leads(detect_chains(collect_leads(places, country)))


