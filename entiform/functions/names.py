"""Keys built from company, city and person names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from entiform import fixed
from entiform.functions.text import BLANK, alnum, collapse, drop_words, fold, let, strip_accents, trim, word


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs.items())])


def normalize_city(raw: Column) -> Column:
    """Readable city: region cut off, known spellings mapped, else title case; '' when absent."""
    cleaned = trim(F.regexp_replace(collapse(raw), "(?s) *[,–-].*$", ""))
    return let(cleaned, lambda c: F.coalesce(
        F.try_element_at(literal_map(fixed.CITY_ALIASES), fold(c)), F.initcap(F.lower(c)), F.lit("")))


def city_key(raw: Column) -> Column:
    return alnum(fold(normalize_city(raw)))


def company_key(name: Column) -> Column:
    return F.coalesce(alnum(drop_words(fold(name), fixed.COMPANY_WORDS)), F.lit(""))


def brand_key(name: Column) -> Column:
    return F.coalesce(alnum(drop_words(fold(name), fixed.BRAND_WORDS)), F.lit(""))


def _significant(name: Column) -> Column:
    """Accent-free words of 2+ characters that are no stop words, each after one space."""
    spaced = F.regexp_replace(F.translate(fold(name), "'’", ""), "[^a-z0-9]+", " ")
    short = "(?<![a-z0-9])(?:[a-z0-9]|" + "|".join(fixed.SLUG_WORDS) + ")(?![a-z0-9])"
    return F.regexp_replace(spaced, short, "")


def tokens(name: Column) -> Column:
    """Significant words in order (array)."""
    return F.array_remove(F.split(_significant(name), " +"), "")


def canonical_name(name: Column) -> Column:
    return F.replace(_significant(name), F.lit(" "), F.lit(""))


def canonical_city(city: Column) -> Column:
    return alnum(fold(city))


def slug(name: Column, city: Column) -> Column:
    tail = F.coalesce(F.nullif(canonical_name(name), F.lit("")), F.lit(fixed.EMPTY_SLUG))
    return F.concat(canonical_city(city), F.lit("-"), tail)


def plain_form(name: Column) -> Column:
    """Compact form for edit-distance matching."""
    return alnum(drop_words(fold(name), fixed.FORM_WORDS))


def hyphen_slug(name: Column, city: Column) -> Column:
    body = drop_words(fold(name), fixed.FORM_WORDS)
    body = F.btrim(F.regexp_replace(body, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(canonical_city(city), F.lit("-"), body)


def slug_hash(name: Column, city: Column) -> Column:
    return F.substring(F.sha2(hyphen_slug(name, city), 256), 1, 12)


def lead_id(source: Column, name: Column, city: Column) -> Column:
    """Stable id; `city` is already normalised."""
    basis = F.concat_ws("|", source, F.lower(trim(name)), alnum(fold(city)))
    return F.concat(source, F.lit("_"), F.substring(F.sha1(F.when(source.isNotNull(), basis)), 1, 16))


def infer_role(title: Column) -> Column:
    """First role whose pattern occurs in the accent-free or the raw title."""
    def role_in(both: Column) -> Column:
        role = None
        for name, anywhere, alone in fixed.ROLE_PATTERNS:
            hit = F.rlike(both, F.lit("(?iu)" + anywhere + (f"|{word(alone)}" if alone else "")))
            role = F.when(hit, F.lit(name)) if role is None else role.when(hit, F.lit(name))
        return role.otherwise(F.lit(fixed.DEFAULT_ROLE))

    return let(F.concat_ws("\n", strip_accents(title), title), role_in)


def known_brand(name: Column, brands=fixed.KNOWN_BRANDS) -> Column:
    """First brand, in list order, whose words stand alone in the name; NULL when none."""
    patterns = [(b, p.replace(" ", BLANK)) for b, p in brands]
    first = F.coalesce(*[F.when(F.rlike(name, F.lit("(?iu)" + word(p))), F.lit(b)) for b, p in patterns])
    # few names hold any of them at all
    return F.when(F.rlike(name, F.lit("(?iu)" + "|".join(f"(?:{p})" for _, p in patterns))), first)


def country_iso(country: Column) -> Column:
    return F.try_element_at(literal_map(fixed.COUNTRY_ISO), F.lower(trim(country)))
