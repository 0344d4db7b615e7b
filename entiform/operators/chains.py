"""Brands and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiform import fixed, schemas
from entiform.functions import names
from entiform.functions.storage import settle
from entiform.functions.text import trim
from entiform.operators.brands import match_brands
from entiform.operators.lookups import lookup_join


def match_brand(leads: DataFrame, brands=fixed.KNOWN_BRANDS) -> DataFrame:
    """Adds `known_brand`: the first brand that occurs in the company name.

    `brands` is a list of (name, pattern) in order, compiled into the plan, or a table (prio, name, phrase) of any size.
    """
    if isinstance(brands, DataFrame):
        return match_brands(leads, brands)
    return leads.withColumn("known_brand", names.known_brand(F.col("company_name"), brands))


def detect_chains(leads: DataFrame, ord: str = "ord", brands=fixed.KNOWN_BRANDS) -> DataFrame:
    """Sets `chain`: a known brand, else a brand key seen in two or more cities.

    Two cities exist exactly when the smallest and the largest differ, so no set of cities is built, and
    only multi-city brands are joined back. Leads with their keys are read by both sides, so they are stored once.
    """
    keyed = settle(with_brand_keys(leads, brands), "brand-keys")
    return with_chains(keyed, brand_spread(keyed, ord).filter("lo <> hi").select("_brand", "_label", "_rows"))


def with_brand_keys(leads: DataFrame, brands=fixed.KNOWN_BRANDS) -> DataFrame:
    """Adds the known brand (`_known`) and the brand key (`_brand`) of each name."""
    known = match_brand(leads, brands).withColumnRenamed("known_brand", "_known")
    return known.withColumn("_brand", F.nullif(names.brand_key(F.col("company_name")), F.lit("")))


def brand_spread(keyed: DataFrame, ord: str = "ord") -> DataFrame:
    """By brand key: smallest and largest city, first label and where it stood, and rows. All of it merges."""
    city = F.nullif(names.city_key(F.col("city")), F.lit(""))
    return (
        keyed.select("_brand", F.coalesce(city, F.col("id")).alias("c"), ord,
                     trim(F.col("company_name")).alias("label"))
        .filter(F.col("_brand").isNotNull())
        .groupBy("_brand")
        .agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min_by("label", ord).alias("_label"),
             F.min(ord).alias("_first"), F.count("*").alias("_rows"))
    )


def with_chains(keyed: DataFrame, spread: DataFrame) -> DataFrame:
    """Sets `chain` from the known brand, else from the brands of two or more cities (_brand, _label, _rows)."""
    label = F.coalesce(F.col("_known"), F.col("_label"))
    chain = F.struct(label.isNotNull().alias("is_chain"), label.alias("name")).cast(schemas.CHAIN)
    joined = lookup_join(keyed, spread, ["_brand"], weight="_rows")
    return joined.withColumn("chain", chain).drop("_brand", "_known", "_label", "_rows")
