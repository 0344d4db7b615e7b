"""Brands of a table met in company names.

A brand row is (prio, name, phrase): the words of `phrase` must stand alone in a company name, one after the other; of all that do, the smallest
prio counts. Letters are compared without case, a blank of a phrase is any one blank, and a word edge is one of ASCII word characters, as in
the compiled list of `known_brand`.

The phrase's runs of ASCII word characters are whole runs of any name that holds it, side by side and in order. So phrases are keyed by these
runs, names give their own runs in sequences as long as the phrases have them, and one join by that key leaves little but true hits to verify.
Neither work nor plan grows with phrases times names. A name is looked up once, however many leads carry it. Phrases without any such run are keyed
by their first character, and only where the table has such phrases do names give their characters.

Null or blank names match nothing, and so do null phrases; among equal prios the smallest name counts. An empty table gives no brand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform.functions.storage import settle
from entiform.functions.text import BLANKS, EDGE
from entiform.operators.lookups import lookup_join

#: Letters that are equal to an ASCII letter without case, though their lower case is none.
_ODD, _ASCII = "ſıİ", "sii"


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def _plain(text: Column) -> Column:
    return F.translate(text, _ODD, _ASCII)


def _character(text: Column) -> Column:
    return F.concat(F.lit("="), F.substring(F.lower(_plain(text)), 1, 1))


def _pattern(phrase: Column) -> Column:
    """The phrase as a pattern: its characters as they stand, any blank for a blank, edges at both ends."""
    escaped = F.regexp_replace(phrase, r"([^\p{L}\p{M}\p{N}\s_])", r"\\$1")
    return F.concat(F.lit(f"(?iu){EDGE}(?:"), F.replace(escaped, F.lit(" "), F.lit(f"[{BLANKS}]")), F.lit(f"){EDGE}"))


def _keyed_brands(brands: DataFrame) -> DataFrame:
    """(key, n, prio, name, pattern): n runs make the key, 0 where a phrase has none."""
    given = brands.where(F.col("phrase").isNotNull() & (F.col("phrase") != "")).withColumn("runs", _runs(_plain(F.col("phrase"))))
    key = F.when(F.size("runs") > 0, F.array_join("runs", " ")).otherwise(_character(F.col("phrase")))
    return (given.select(key.alias("key"), F.size("runs").alias("n"), "prio", "name", _pattern(F.col("phrase")).alias("pattern"))
            .groupBy("key", "n", "pattern").agg(F.min(F.struct("prio", "name")).alias("first")).select("key", "n", "first.*", "pattern"))


def _sequences(runs: Column, n: int) -> Column:
    """Each sequence of n runs; none where there are fewer."""
    some = F.transform(F.sequence(F.lit(0), F.size(runs) - n), lambda i: F.concat_ws(" ", *[F.get(runs, i + k) for k in range(n)]))
    return F.when(F.size(runs) >= n, some).otherwise(F.array().cast("array<string>"))


def _keys(runs: Column, plain: Column, text: Column, lengths: list[int]) -> Column:
    """Keys of a name for phrases of these numbers of runs."""
    own = [_sequences(r, n) for n in lengths if n for r in (runs, plain)]
    if 0 in lengths:
        own.append(F.transform(F.split(F.lower(_plain(text)), ""), lambda c: F.concat(F.lit("="), c)))
    return F.array_distinct(F.concat(*own))


def match_brands(leads: DataFrame, brands: DataFrame, company: str = "company_name", into: str = "known_brand") -> DataFrame:
    """Adds `into`: the name of the first brand whose phrase stands in the company name."""
    table = settle(_keyed_brands(brands), "brands")
    lengths = sorted(r["n"] for r in table.select("n").distinct().collect())  # a few numbers: the words of phrases
    rest = leads.drop(into)
    if not lengths:
        return rest.withColumn(into, F.lit(None).cast("string"))
    named = leads.select(F.col(company).alias("_company")).where(F.col("_company").isNotNull()).distinct()
    runs = named.withColumns({"_runs": _runs(F.col("_company")), "_plain": _runs(_plain(F.col("_company")))})
    probes = runs.select("_company", F.explode_outer(_keys(F.col("_runs"), F.col("_plain"), F.col("_company"), lengths)).alias("key")).where(F.col("key").isNotNull())
    met = lookup_join(probes, table.select("key", "prio", "name", "pattern"), ["key"])
    hits = met.where(F.col("pattern").isNotNull() & F.rlike("_company", F.col("pattern")))
    found = settle(hits.groupBy("_company").agg(F.min(F.struct("prio", "name")).alias("first"), F.count("*").alias("_n")).select(F.col("_company").alias(company), F.col("first.name").alias(into)), "brand-names")
    return lookup_join(rest, found, [company])
