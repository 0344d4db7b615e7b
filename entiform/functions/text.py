"""Blank handling, accent folding and word removal as native expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every blank of web text. Spark's own \s and trim() miss the no-break spaces of French numbers.
BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Ranges that hold all of them come first: most characters are in none, and a pattern asks no further.
BLANK = "[\t- \u00a0\u1680-\ufeff&&[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]"
# Word edge over ASCII word characters (Java's \b also counts accented letters on JDK 17).
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _accent_pairs() -> tuple[str, str]:
    """Translate table: accented character -> base letter; combining marks have no counterpart."""
    source, target = [], []
    for code in range(0xC0, min(0xFFFF, sys.maxunicode)):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if not 0x300 <= ord(c) <= 0x36F)
        if len(plain) == 1 and plain != char:
            source.append(char)
            target.append(plain)
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(source) + marks, "".join(target)


ACCENTED, PLAIN = _accent_pairs()


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.btrim(F.regexp_replace(c, f"{BLANK}+", " "), F.lit(" "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def fold(c: Column) -> Column:
    """Accent-free lower case."""
    return F.lower(strip_accents(c))


def alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]+", "")


def word(pattern: str) -> str:
    return f"{EDGE}(?:{pattern}){EDGE}"


def drop_words(c: Column, words: Iterable[str]) -> Column:
    words = list(words)
    # between word characters and none, an edge is that no word character stands beside them
    plain = all(re.fullmatch(r"[A-Za-z0-9_](?:[A-Za-z0-9_' ]*[A-Za-z0-9_])?", w) for w in words)
    alone = f"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"
    return F.regexp_replace(c, alone if plain else word("|".join(words)), "")


def truncate(c: Column, n: int) -> Column:
    """At most n characters; a cut text ends in an ellipsis."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def clean(c: Column) -> Column:
    """Trimmed text; NULL for empty, `null` and `n/a`."""
    t = trim(c)
    return F.when(~F.lower(t).isin("", "null", "n/a"), t)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once inside an array expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join_present(c: Column, sep: str) -> Column:
    return F.coalesce(F.array_join(c, sep), F.lit(""))


def ordered_union(*arrays: Column) -> Column:
    """Trimmed, non-empty, distinct values of several arrays in first-seen order."""
    merged = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.array_distinct(F.filter(F.transform(merged, trim), lambda v: v.isNotNull() & (v != "")))
