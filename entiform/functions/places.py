"""Expressions over raw place listings and review labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from entiform import fixed
from entiform.functions.text import BLANK, EDGE, collapse, trim


def _first_number(text: Column) -> Column:
    return F.regexp_extract(text, "[0-9]+(?:[.][0-9]+)?", 0)


def _rating(number: Column) -> Column:
    value = number.try_cast("double")
    return F.when(value.between(0, 5), value)


def parse_rating(text: Column) -> Column:
    """First number, its first comma read as a decimal point; only 0..5."""
    return _rating(_first_number(F.regexp_replace(text, "(?s)^([^,]*),", "$1.")))


def rating_label(label: Column) -> Column:
    """Number before `étoile` or `star`, else the first number of the label as written; only 0..5."""
    dotted = F.regexp_replace(label, "(?s)^([^,]*),", "$1.")
    starred = F.regexp_extract(dotted, f"(?iu)([0-9]+(?:[.][0-9]+)?){BLANK}*(?:étoile|star)", 1)
    return _rating(F.when(starred != "", starred).otherwise(_first_number(label)))


def parse_review_count(text: Column) -> Column:
    """All digits of the text as one number."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("bigint")


def city_from_address(address: Column) -> Column:
    """Last comma segment that is no country word, without 4-6 digit codes, and not only digits."""
    parts = F.transform(F.split(address, ","), trim)
    named = F.filter(parts, lambda s: (s != "") & ~F.lower(s).isin(*fixed.COUNTRY_WORDS))
    code = f"{EDGE}[0-9]{{4,6}}{EDGE}"
    bare = F.transform(named, lambda s: collapse(F.regexp_replace(s, code, "")))
    usable = F.filter(bare, lambda s: ~F.rlike(s, F.lit("^[0-9]*$")))
    return F.get(F.reverse(usable), F.lit(0))


def lat_lng(url: Column) -> Column:
    """struct<latitude, longitude> from a place URL."""
    number = "(-?[0-9]+[.][0-9]+)"
    pin, view = f"!3d{number}!4d{number}", f"@{number},{number}"

    def part(i: int) -> Column:
        pinned = F.regexp_extract(url, pin, i)
        return F.when(pinned != "", pinned).otherwise(F.regexp_extract(url, view, i)).try_cast("double")

    return F.struct(part(1).alias("latitude"), part(2).alias("longitude"))


def clean_place_address(address: Column) -> Column:
    return F.regexp_replace(trim(address), f"(?i)^Adresse:{BLANK}*", "")


def clean_place_phone(phone: Column) -> Column:
    return trim(F.replace(phone, F.lit("phone:tel:"), F.lit("")))


def pick_category(candidates: Column, longest: int | None = fixed.CATEGORY_MAX_LENGTH) -> Column:
    """First candidate that is not empty, no action button and at most `longest` characters long (None: any)."""
    action = "(?iu)^(?:" + "|".join(fixed.ACTION_WORDS) + ")"
    kept = F.filter(F.transform(candidates, trim), lambda c: (
        (c != "") & (F.lit(True) if longest is None else F.length(c) <= longest) & ~F.rlike(c, F.lit(action))))
    return F.get(kept, F.lit(0))
