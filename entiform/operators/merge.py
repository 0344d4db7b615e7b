"""Merging patches into leads without losing known values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform import fixed, schemas
from entiform.functions.text import let, ordered_union

_CONTACT_TEXT = ("full_name", "role", "title_raw", "email_direct", "phone_direct", "linkedin_url")


def merge_contacts(current: Column, incoming: Column) -> Column:
    """One contact per lower-cased name in first-seen order.

    Later non-empty fields win; the highest confidence stays. Works inside the row, so nothing is shuffled.
    """
    none = F.array().cast(f"array<{schemas.CONTACT}>")

    def merged(every: Column) -> Column:
        def one(group: Column) -> Column:
            def last(field: str) -> Column:
                given = F.filter(F.transform(group, lambda c: c[field]), lambda v: v.isNotNull() & (v != ""))
                return F.try_element_at(given, F.lit(-1))

            confidence = F.array_max(F.transform(group, lambda c: c["confidence"]))
            return F.struct(*[last(f).alias(f) for f in _CONTACT_TEXT], confidence.alias("confidence"))

        names = F.array_distinct(F.transform(every, lambda c: F.lower(c["full_name"])))
        return F.transform(names, lambda name: let(F.filter(every, lambda c: F.lower(c["full_name"]) == name), one))

    # bound once: each use of a plain expression would work out both arrays anew
    return let(F.concat(F.coalesce(current, none), F.coalesce(incoming, none)), merged)


def fill_socials(current: Column, incoming: Column) -> Column:
    """Known networks stay, missing ones are filled."""
    return F.struct(*[
        F.coalesce(F.nullif(current[n], F.lit("")), F.nullif(incoming[n], F.lit(""))).alias(n)
        for n in fixed.SOCIAL_FIELDS])


def _merge_maps(current: Column, incoming: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(current, empty), F.coalesce(incoming, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def apply_patch(leads: DataFrame, patch: DataFrame, stage: str) -> DataFrame:
    """Leads with one stage's patch (ord and any of the patch fields; NULL = absent) merged in.

    A patch belongs to the row with its `ord`, since different leads may share an id. A lead without a patch row stays as it is.
    """
    have = [c for c in schemas.PATCH_FIELDS if c in patch.columns]
    renamed = patch.select("ord", F.lit(True).alias("_patched"), *[F.col(c).alias(f"_p_{c}") for c in have])
    joined = leads.join(renamed, "ord", "left")

    def new(field: str) -> Column:
        return F.col(f"_p_{field}") if field in have else F.lit(None).cast(schemas.PATCH_FIELDS[field])

    def old(field: str) -> Column:
        return F.col(field)

    def present(field: str) -> Column:
        return F.nullif(old(field), F.lit(""))

    merged: dict[str, Column] = {
        f: F.when(new(f).isNotNull(), ordered_union(old(f), new(f))).otherwise(old(f)) for f in ("emails", "phones")}
    merged["socials"] = F.when(new("socials").isNotNull(), fill_socials(old("socials"), new("socials"))).otherwise(
        old("socials"))
    merged["contacts"] = F.when(
        F.size(new("contacts")) > 0, merge_contacts(old("contacts"), new("contacts"))).otherwise(old("contacts"))
    for f in ("email", "legal_name", "employee_range", "category"):
        merged[f] = F.coalesce(present(f), F.nullif(new(f), F.lit("")), old(f))
    for f in ("email_status", "email_catch_all", "chain"):
        merged[f] = F.coalesce(new(f), old(f))
    # the patch's reviews win field by field; its list of highlights always counts
    reviews = ("count", "average", "summary", "sentiment", "highlights")
    merged["reviews"] = F.when(new("reviews").isNotNull(), F.struct(*[
        F.coalesce(new("reviews")[n], old("reviews")[n]).alias(n) for n in reviews])).otherwise(old("reviews"))
    merged["metadata"] = F.when(new("metadata").isNotNull(), _merge_maps(old("metadata"), new("metadata"))).otherwise(
        old("metadata"))
    merged["email_checks"] = F.coalesce(new("email_checks"), old("email_checks"))
    merged["enriched_by"] = ordered_union(old("enriched_by"), F.array(F.lit(stage)))
    touched = [f for f in merged if f in have or f == "enriched_by"]
    values = {
        f: F.when(F.col("_patched"), merged[f]).otherwise(old(f)).cast(schemas.LEAD_FIELDS[f]).alias(f)
        for f in touched}
    return joined.select(*[values.get(c, F.col(c)) for c in leads.columns])
