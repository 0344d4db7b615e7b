"""Enrichment stages: each turns eligible leads into patch rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiform import fixed
from entiform.functions.phone import PLANS
from entiform.functions.storage import Scratch
from entiform.operators.emails import email_verdicts
from entiform.operators.extract import enrich_from_pages
from entiform.operators.leads import eligible
from entiform.operators.merge import apply_patch
from entiform.operators.reviews import review_insight


class Stage(Protocol):
    """A source of patches. A lead without a patch row is left unchanged."""

    name: str

    def eligible(self, leads: DataFrame) -> DataFrame: ...

    def patch(self, leads: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame: ...


class _Builtin:
    name = ""

    def eligible(self, leads: DataFrame) -> DataFrame:
        return eligible(leads, self.name)


class WebsiteStage(_Builtin):
    """Reads `pages`."""

    name = "website"

    def __init__(self, country: str = fixed.DEFAULT_COUNTRY, max_pages: int = fixed.MAX_PAGES, plans=PLANS):
        self.country, self.max_pages, self.plans = country, max_pages, plans

    def patch(self, leads, tables):
        return enrich_from_pages(leads, tables["pages"], self.country, self.max_pages, self.plans)


class EmailStage(_Builtin):
    """Reads `domain_facts` and, when given, `address_facts`."""

    name = "email"

    def patch(self, leads, tables):
        return email_verdicts(leads, tables["domain_facts"], tables.get("address_facts"))


class ReviewStage(_Builtin):
    """Reads `reviews` and, when given, `summaries`."""

    name = "reviews"

    def patch(self, leads, tables):
        return review_insight(leads, tables["reviews"], tables.get("summaries"))


_STAGES = {"website": WebsiteStage, "email": EmailStage, "reviews": ReviewStage}


def parse_stages(spec: str | None) -> list[str]:
    """`all` or a comma list; fixed order, unknown names ignored."""
    wanted = (spec or "").strip().lower()
    if wanted == "all":
        return list(fixed.STAGES)
    names = {n.strip() for n in wanted.split(",")}
    return [n for n in fixed.STAGES if n in names]


def make_stages(spec: str | None) -> list[Stage]:
    return [_STAGES[n]() for n in parse_stages(spec)]


def run_stages(leads: DataFrame, stages: Iterable[Stage], tables: Mapping[str, DataFrame], scratch: Scratch | None = None) -> DataFrame:
    """Leads after all stages, each marked as attempted.

    A stage reads its leads several times (for the patch and for the merge), so they are stored before it. While stages run, `ord` is a
    number that no two rows share, also when leads of several runs meet.
    """
    scratch = scratch or Scratch(leads.sparkSession, "stages")
    leads = leads.withColumn("_arrival", F.col("ord")).withColumn("ord", F.monotonically_increasing_id())
    for stage in stages:
        leads = scratch.write(leads, f"before-{stage.name}")
        leads = apply_patch(leads, stage.patch(stage.eligible(leads), tables), stage.name)
    return leads.withColumn("ord", F.col("_arrival")).drop("_arrival").withColumn("enrich_attempted", F.lit(True))
