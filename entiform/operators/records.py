"""Researched records: scoring, delivery and upserts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform import fixed, schemas
from entiform.functions import names, web
from entiform.functions.phone import PLANS, standardize_phone
from entiform.functions.text import clean
from entiform.operators.leads import number_text
from entiform.operators.lookups import lookup_join


def lookup_country(df: DataFrame, country: str = "country", plans=PLANS) -> DataFrame:
    """Adds iso2 and calling_code of the country's numbering plan; NULL when unknown."""
    codes = names.literal_map({p.iso2: p.calling_code for p in plans})
    return df.withColumn("iso2", names.country_iso(F.col(country))).withColumn(
        "calling_code", F.try_element_at(codes, F.col("iso2")))


def lookup_city(df: DataFrame, city: str = "city") -> DataFrame:
    """Adds city_name and city_key."""
    return df.withColumns({"city_name": names.normalize_city(F.col(city)), "city_key": names.city_key(F.col(city))})


def to_records(answered: DataFrame, model: str, threshold: float = fixed.REVIEW_THRESHOLD,
               enriched_at: Column | None = None, plans=PLANS) -> DataFrame:
    """Tasks with a `parsed` answer and a `sources` array to records.

    Without sources the confidence is capped and the record needs a review.
    """
    answer = {n: F.col(f"parsed.{n}") for n in schemas.ANSWER_FIELDS}
    owner, management = clean(answer["owner"]), clean(answer["management"])
    searched = F.size("sources") > 0
    named = owner.isNotNull() | management.isNotNull()
    own = F.coalesce(answer["governance_confidence"],
                     F.when(named, F.lit(fixed.CONFIDENCE_WITHOUT_SOURCES)).otherwise(F.lit(0.0)))
    confidence = F.when(searched, own).otherwise(F.least(own, F.lit(fixed.CONFIDENCE_WITHOUT_SOURCES)))
    staged = answered.withColumns({"_phone_raw": clean(answer["phone"]), "_confidence": confidence})
    staged = staged.withColumn(
        "_phone", standardize_phone(F.col("_phone_raw"), names.country_iso(F.col("country")), plans))
    review = ~searched | ~named | (F.col("_confidence") < threshold)
    values = {
        "slug": names.slug(F.col("input_name"), F.col("city")),
        "input_name": F.col("input_name"),
        "name": F.coalesce(clean(answer["name"]), F.col("input_name")),
        "city": F.col("city"),
        "country": F.col("country"),
        "phone": F.col("_phone_raw"),
        "phone_e164": F.col("_phone.e164"),
        "email": F.lower(clean(answer["email"])),
        "website": web.clean_record_url(answer["website"]),
        "latitude": answer["latitude"],
        "longitude": answer["longitude"],
        "owner": owner,
        "management": management,
        "governance_confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_confidence"))),
        "sources": F.filter("sources", lambda s: F.rlike(s, F.lit("^https?://"))),
        "status": F.when(review, F.lit("needs_review")).otherwise(F.lit("auto")),
        "model": F.lit(model),
        "enriched_at": enriched_at if enriched_at is not None else F.lit(None),
        **{n: clean(answer[n]) for n in ("category", "district", "address")},
    }
    order = [c for c in ("task_ord",) if c in answered.columns]
    return staged.select(*order, *[values[n].cast(t).alias(n) for n, t in schemas.RECORD_FIELDS.items()])


def delivery_view(records: DataFrame, labels: bool = False, longest: int | None = fixed.DELIVERY_TEXT_CUT) -> DataFrame:
    """The 15 delivery columns, keyed or with their labels; texts are cut to `longest` characters (None: whole)."""
    def cut(c: Column) -> Column:
        return c if longest is None else F.substring(c, 1, longest)

    geo = F.concat_ws(", ", number_text(F.col("latitude")), number_text(F.col("longitude")))
    values = {
        "name": cut(F.col("name")),
        "city": F.col("city"),
        "category": cut(F.col("category")),
        "phone": F.coalesce("phone_e164", "phone"),
        "owner": cut(F.coalesce("owner", F.lit(fixed.UNKNOWN_PERSON))),
        "management": cut(F.coalesce("management", F.lit(fixed.UNKNOWN_PERSON))),
        "confidence": F.round("governance_confidence", 2),
        "district": cut(F.col("district")),
        "geo": F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), geo),
        "address": cut(F.col("address")),
        "email": F.col("email"),
        "website": F.col("website"),
        "sources": F.nullif(cut(F.array_join("sources", "\n")), F.lit("")),
        "status": F.try_element_at(names.literal_map(fixed.STATUS_LABELS), F.col("status")),
        "slug": cut(F.col("slug")),
    }
    return records.select(*[values[k].alias(label if labels else k) for k, label in fixed.DELIVERY_COLUMNS])


def upsert_by_key(existing: DataFrame, incoming: DataFrame, key: str = "slug") -> DataFrame:
    """The new table with an `outcome` per row: created, updated or kept. Both sides hold a key once."""
    columns = [c for c in existing.columns if c != key]
    old = existing.select(key, F.struct(*columns).alias("_old"))
    new = incoming.select(key, F.struct(*[F.col(c).cast(existing.schema[c].dataType).alias(c) for c in columns]).alias("_new"))
    merged = old.join(new, key, "full_outer")
    outcome = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "created").otherwise("updated")
    row = F.coalesce("_new", "_old")
    return merged.select(key, *[row[c].alias(c) for c in columns], outcome.alias("outcome"))


def match_existing(records: DataFrame, existing: DataFrame, key: str = "slug") -> DataFrame:
    """Records with `outcome`: updated when the key is already stored, else created."""
    stored = existing.select(key, F.lit(True).alias("_stored")).distinct()
    return lookup_join(records, stored, [key]).withColumn(
        "outcome", F.when(F.col("_stored"), F.lit("updated")).otherwise(F.lit("created"))).drop("_stored")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row from `result` (enriched, skipped, failed), `status` and `outcome` (created, updated)."""
    def n(condition: Column, name: str) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)

    result, outcome = F.col("result"), F.col("outcome")
    return outcomes.agg(
        F.count("*").alias("total"), n(result == "enriched", "enriched"), n(result == "skipped", "skipped"),
        n(result == "failed", "failed"), n(F.col("status") == "needs_review", "needs_review"),
        n(outcome == "created", "created"), n(outcome == "updated", "updated"))


def check_target_schema(df: DataFrame, required: Iterable[str]) -> None:
    """Raises with the names of all missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
