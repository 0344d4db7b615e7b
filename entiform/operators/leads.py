"""Raw listings to validated leads, and leads to delivery tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform import fixed, schemas
from entiform.functions import names, places, text, web
from entiform.functions.phone import PLANS, standardize_phone
from entiform.functions.storage import settle


def _col(df: DataFrame, name: str, type_: str) -> Column:
    """The column, or NULL of its type when the input does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(type_)


def search_grid(queries: Sequence[str], locations: DataFrame, country: str = fixed.DEFAULT_COUNTRY,
                limit: int = 0, location: str = "location") -> DataFrame:
    """Every query at every location; blanks trimmed, empty values dropped.

    The queries are options of a run (a short list), so each location is expanded in place.
    """
    wanted = [q.strip(text.BLANKS) for q in queries]
    wanted = [q for q in wanted if q]
    if not wanted:
        raise ValueError("at least one query is required")
    place = text.trim(F.col(location))
    named = locations.filter(place != "")
    if named.isEmpty():
        raise ValueError("at least one location is required")
    return named.select(
        F.explode(F.array(*[F.lit(q) for q in wanted])).alias("query"),
        place.alias("location"), F.lit(country.upper()).alias("country"), F.lit(limit).cast("bigint").alias("limit"))


def city_refs(specs: DataFrame, spec: str = "spec", default_country: str = fixed.DEFAULT_CITY_COUNTRY) -> DataFrame:
    """`city:country` split and trimmed; an empty city is an error."""
    parts = F.split(F.col(spec), ":")
    city = text.blank_to_null(F.get(parts, F.lit(0)))
    country = text.blank_to_null(F.get(parts, F.lit(1)))
    checked = F.when(city.isNull(), F.raise_error(F.concat(F.lit("no city in: "), F.col(spec))).cast("string"))
    return specs.select(
        *[c for c in specs.columns if c != spec],
        F.coalesce(checked, city).alias("city"), F.coalesce(country, F.lit(default_country)).alias("country"))


def clean_place_fields(df: DataFrame, candidates: str = "category_candidates") -> DataFrame:
    """Label prefixes removed from address and phone; category = first real candidate."""
    return df.withColumns({
        "address": places.clean_place_address(F.col("address")),
        "phone": places.clean_place_phone(F.col("phone")),
        "category": places.pick_category(F.col(candidates)),
    }).drop(candidates)


def parse_places(df: DataFrame, country: str = fixed.DEFAULT_COUNTRY, fallback_city: Column | None = None) -> DataFrame:
    """Listing strings to raw leads; the city comes from the address, else from the search."""
    fallback = fallback_city if fallback_city is not None else F.lit(None).cast("string")
    point = places.lat_lng(F.col("place_url"))
    extra = [c for c in ("search_id", "fallback_city") if c in df.columns]
    return df.select(
        "ord", *extra,
        F.lit(fixed.PLACE_SOURCE).alias("source"),
        F.col("place_url").alias("source_url"),
        text.trim(F.col("name")).alias("company_name"),
        text.trim(F.col("category")).alias("category"),
        F.coalesce(places.city_from_address(F.col("address")), fallback).alias("city"),
        F.lit(country).alias("country"),
        text.trim(F.col("address")).alias("address"),
        F.coalesce(_col(df, "latitude", "double"), point["latitude"]).alias("latitude"),
        F.coalesce(_col(df, "longitude", "double"), point["longitude"]).alias("longitude"),
        text.trim(F.col("phone")).alias("phone_raw"),
        text.trim(F.col("website")).alias("website_url"),
        places.parse_rating(F.col("rating_text")).alias("google_rating"),
        places.parse_review_count(F.col("reviews_text")).alias("reviews_count"),
    )


def _clean_contact(c: Column, country: Column, plans) -> Column:
    return F.struct(
        text.trim(c["full_name"]).alias("full_name"),
        F.coalesce(c["role"], names.infer_role(c["title_raw"])).alias("role"),
        text.trim(c["title_raw"]).alias("title_raw"),
        web.clean_email(c["email_direct"]).alias("email_direct"),
        standardize_phone(c["phone_direct"], country, plans)["e164"].alias("phone_direct"),
        web.clean_url(c["linkedin_url"]).alias("linkedin_url"),
        F.coalesce(c["confidence"], F.lit(1.0)).alias("confidence"),
    )


def normalize_leads(raw: DataFrame, default_country: str = fixed.DEFAULT_COUNTRY, fallback_city: str | None = None,
                    plans=PLANS) -> DataFrame:
    """Raw leads to the lead schema. A `fallback_city` column overrides the argument row by row."""
    def of(name: str) -> Column:
        return _col(raw, name, schemas.LEAD_FIELDS[name])

    fallback = F.coalesce(_col(raw, "fallback_city", "string"), F.lit(fallback_city).cast("string"))
    own_city = names.normalize_city(of("city"))
    staged = raw.withColumns({
        "_country": F.upper(F.coalesce(of("country"), F.lit(default_country))),
        "_city": text.let(own_city, lambda c: F.when(c != "", c).otherwise(names.normalize_city(fallback))),
        "_name": text.collapse(of("company_name")),
    })
    staged = staged.withColumn("_phone", standardize_phone(
        F.coalesce(of("phone_raw"), of("phone_normalized")), F.col("_country"), plans))
    contacts = (
        F.transform(F.col("contacts").cast(f"array<{schemas.CONTACT}>"),
                    lambda c: _clean_contact(c, F.col("_country"), plans))
        if "contacts" in raw.columns else F.lit(None)
    )
    empty_strings = F.array().cast("array<string>")
    values = {
        "id": F.coalesce(of("id"), names.lead_id(of("source"), F.col("_name"), F.col("_city"))),
        "source_url": web.clean_url(of("source_url")),
        "company_name": F.col("_name"),
        "category": text.blank_to_null(of("category")),
        "city": F.col("_city"),
        "country": F.when(F.length("_country") == 2, F.col("_country")).otherwise(F.lit(fixed.DEFAULT_COUNTRY)),
        "address": F.nullif(text.collapse(of("address")), F.lit("")),
        "phone_raw": text.blank_to_null(of("phone_raw")),
        "phone_normalized": F.col("_phone.e164"),
        "email": web.clean_email(of("email")),
        "website_url": web.clean_url(of("website_url")),
        "emails": empty_strings,
        "phones": empty_strings,
        "enriched_by": empty_strings,
        "contacts": F.coalesce(contacts.cast(f"array<{schemas.CONTACT}>"), F.array().cast(f"array<{schemas.CONTACT}>")),
        "metadata": F.coalesce(of("metadata"), F.create_map().cast("map<string,string>")),
        "phone_valid": F.col("_phone.valid"),
    }
    kept = {n: of(n) for n in ("ord", "source", "latitude", "longitude", "google_rating", "reviews_count", "scraped_at")}
    fields = [
        {**kept, **values}.get(n, F.lit(None)).cast(t).alias(n) for n, t in schemas.LEAD_FIELDS.items()
    ]
    return staged.select(*fields, *[c for c in ("search_id",) if c in raw.columns])


def _bad(condition: Column, reason: str) -> Column:
    return F.when(condition, F.lit(reason))


def with_reject_reasons(leads: DataFrame) -> DataFrame:
    """Adds `reject_reasons` (array, empty for a valid lead). One bad contact rejects the lead."""
    def url_bad(c: Column) -> Column:
        return c.isNotNull() & ~web.is_url(c)

    def contact_reasons(c: Column) -> Column:
        return F.array_compact(F.array(
            _bad(F.coalesce(c["full_name"] == "", F.lit(True)), "contact_name"),
            _bad(~c["role"].isin(*fixed.ROLES), "contact_role"),
            _bad(~c["confidence"].between(0, 1), "contact_confidence"),
            _bad(~web.email_ok(c["email_direct"]), "contact_email"),
            _bad(url_bad(c["linkedin_url"]), "contact_url")))

    reasons = F.array_compact(F.array(
        _bad(F.coalesce(F.col("company_name") == "", F.lit(True)), "company_name"),
        _bad(F.coalesce(F.col("source") == "", F.lit(True)), "source"),
        _bad(~F.col("google_rating").between(0, 5), "google_rating"),
        _bad(F.col("reviews_count") < 0, "reviews_count"),
        _bad(~web.email_ok(F.col("email")), "email"),
        _bad(url_bad(F.col("source_url")), "source_url"),
        _bad(url_bad(F.col("website_url")), "website_url"),
        _bad(F.exists("emails", lambda e: ~web.email_ok(e)), "emails"),
    ))
    of_contacts = F.array_distinct(F.flatten(F.transform("contacts", contact_reasons)))
    return leads.withColumn("reject_reasons", F.concat(reasons, of_contacts))


def validate_leads(leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid leads, rejected leads with their reasons).

    Judged leads are stored: the filters on the reasons would otherwise be moved below them, with all that leads are made of in each.
    """
    judged = settle(with_reject_reasons(leads), "judged")
    valid = judged.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
    return valid, judged.filter(F.size("reject_reasons") > 0)


def number_text(c: Column) -> Column:
    """Shortest text of a number: no trailing `.0`."""
    return F.regexp_replace(c.cast("string"), "[.]0$", "")


def best_contact(contacts: Column) -> Column:
    """Highest confidence; the earliest on ties."""
    ranked = F.transform(contacts, lambda c, i: F.struct(
        (-F.coalesce(c["confidence"], F.lit(0.0))).alias("rank"), i.alias("pos")))
    return F.get(contacts, F.array_min(ranked)["pos"])


def flatten_leads(leads: DataFrame) -> DataFrame:
    """The 28 delivery columns; NULL becomes ''."""
    best = best_contact(F.col("contacts"))
    special = {
        "chain": F.when(F.col("chain.is_chain"), F.coalesce(F.col("chain.name"), F.lit("Yes"))),
        "phones": F.array_join("phones", " / "),
        "emails": F.array_join("emails", " / "),
        "google_rating": number_text(F.col("google_rating")),
        "reviews_count": F.col("reviews_count").cast("string"),
        "reviews_sentiment": F.col("reviews.sentiment"),
        "reviews_summary": F.col("reviews.summary"),
        "contact_name": best["full_name"],
        "contact_role": best["role"],
        "contact_email": best["email_direct"],
        "contact_linkedin": best["linkedin_url"],
        **{n: F.col(f"socials.{n}") for n in ("linkedin", "facebook", "instagram", "whatsapp")},
    }
    return leads.select(*[
        F.coalesce(special.get(key, F.col(key) if key not in special else None), F.lit("")).alias(key)
        for key, _ in fixed.FLAT_COLUMNS
    ])


def contacts_table(leads: DataFrame) -> DataFrame:
    """One row per contact."""
    return leads.select("company_name", "city", "id", F.posexplode("contacts").alias("pos", "contact")).select(
        F.col("company_name").alias("company"), "city", "id", "pos",
        *[F.col(f"contact.{n}").alias(n) for n in (
            "full_name", "role", "title_raw", "email_direct", "phone_direct", "linkedin_url", "confidence")])


def eligible(leads: DataFrame, stage: str) -> DataFrame:
    """Leads a stage can work on."""
    if stage == "website":
        return leads.filter(F.length("website_url") > 0)
    if stage == "email":
        return leads.filter(
            (F.length("email") > 0) | (F.size("emails") > 0)
            | F.exists("contacts", lambda c: F.coalesce(F.length(c["email_direct"]) > 0, F.lit(False))))
    if stage == "reviews":
        return leads.filter(F.rlike("source_url", F.lit(fixed.PLACE_LINK)))
    raise ValueError(f"unknown stage: {stage}")


def lead_stats(received: DataFrame, rejects: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: received, invalid, duplicates, accepted."""
    counts = [
        received.select(F.lit("received").alias("k")),
        rejects.select(F.lit("invalid").alias("k")),
        decisions.select(F.when(F.col("duplicate"), F.lit("duplicates")).otherwise(F.lit("accepted")).alias("k")),
    ]
    rows = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return rows.agg(*[
        F.count_if(F.col("k") == n).alias(n) for n in ("received", "invalid", "duplicates", "accepted")])


def enrichment_summary(leads: DataFrame) -> DataFrame:
    """One row: leads that a stage touched in this run, chain members, leads finished earlier (`restored`)."""
    restored = _col(leads, "restored", "boolean")
    return leads.agg(
        F.count_if((F.size("enriched_by") > 0) & ~F.coalesce(restored, F.lit(False))).alias("leads_enriched"),
        F.count_if(F.coalesce(F.col("chain.is_chain"), F.lit(False))).alias("chains_detected"),
        F.count_if(F.coalesce(restored, F.lit(False))).alias("resumed"))
