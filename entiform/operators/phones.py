"""Phones by a table of numbering plans.

A plan is a row (prio, iso2, calling_code, idd, trunk, nsn): the patterns of the international and the national prefix and of a valid national
number. The rules are those of `standardize_phone`, which has its plans in the expression; here plans are met by joins, so neither plan nor
expression grows with their number. The plan of a number written with its calling code is the longest code that the number begins with: the codes
form a digit trie, and each depth at which some code ends is one join on as many leading digits, the deepest first.

A number is worked out once for each caller's country, however many rows hold it. A NULL number is not valid and has no country; with a NULL or
unknown country only numbers with their calling code are read. Plans of one iso2, or of one code, count by the smallest prio. An empty plan table
leaves numbers with + as they are, not valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform.functions.phone import candidate, chosen, first_chunk
from entiform.functions.storage import settle
from entiform.operators.lookups import lookup_join

_PLAN = ("iso2", "calling_code", "idd", "trunk", "nsn")


def _first(plans: DataFrame, key: str, into: str) -> DataFrame:
    """One plan for each key, by the smallest prio."""
    best = F.min(F.struct("prio", *_PLAN)).alias("p")
    return plans.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(best).select(
        f"_{key}", F.struct(*[F.col(f"p.{c}").alias(c) for c in _PLAN]).alias(into))


def _after(text: str, prefix: str, rest: str) -> Column:
    """What follows a prefix given by a pattern column; NULL when nothing does."""
    return F.nullif(F.expr(f"regexp_extract({text}, concat('^(?:', {prefix}, '){rest}$'), 1)"), F.lit(""))


def _fits(text: str) -> Column:
    return F.coalesce(F.expr(f"rlike({text}, concat('^(?:', _plan.nsn, ')$'))"), F.lit(False))


def _worked_out(numbers: DataFrame, plans: DataFrame) -> DataFrame:
    """`numbers` (_raw, _iso) with struct `_phone`."""
    by_iso = settle(_first(plans, "iso2", "_home"), "plans-iso")
    by_code = settle(_first(plans, "calling_code", "_met"), "plans-code")
    depths = sorted((r["n"] for r in by_code.select(F.length("_calling_code").alias("n")).distinct().collect() if r["n"]), reverse=True)
    rows = numbers.withColumn("_c", candidate(first_chunk(F.col("_raw")))).join(by_iso, F.col("_iso") == F.col("_iso2"), "left").drop("_iso2")
    dialled = _after("_c", "_home.idd", "([1-9][0-9]*)")
    rows = rows.withColumn("_number", F.when(dialled.isNotNull(), F.concat(F.lit("+"), dialled)).otherwise(F.col("_c")))
    rows = rows.withColumn("_abroad", F.col("_number").startswith("+"))
    for n in depths:
        # Keys that no code equals, one for each number, so that those without a calling code do not gather in one task.
        own = F.when(F.col("_abroad"), F.substring("_number", 2, n)).otherwise(F.concat(F.lit("="), F.col("_raw")))
        level = by_code.where(F.length("_calling_code") == n).withColumnRenamed("_met", f"_met{n}")
        rows = rows.join(level, own == F.col("_calling_code"), "left").drop("_calling_code")
    met = F.coalesce(*[F.col(f"_met{n}") for n in depths]) if depths else F.when(F.lit(False), F.col("_home"))
    rows = rows.withColumn("_found", met)
    code = F.coalesce(F.col("_found.calling_code"), F.lit(""))
    rows = rows.withColumns({
        "_plan": F.when(F.col("_abroad"), F.col("_found")).otherwise(F.col("_home")),
        "_nsn": F.when(F.col("_abroad"), F.substr(F.col("_number"), F.length(code) + 2)).otherwise(F.col("_number"))})
    rows = rows.withColumns({
        "_short": F.when(F.col("_plan.trunk") != "", _after("_nsn", "_plan.trunk", "(.+)")),
        "_bare": F.when(~F.col("_abroad"), _after("_nsn", "_plan.calling_code", "(.+)"))})
    read = F.struct(
        F.col("_plan.iso2").alias("plan"), F.col("_nsn").alias("nsn"), F.col("_abroad").alias("abroad"), F.col("_number").alias("number"),
        F.col("_short").alias("short"), F.col("_bare").alias("bare"), _fits("_nsn").alias("nsn_ok"), _fits("_short").alias("short_ok"), _fits("_bare").alias("bare_ok"))
    rows = rows.withColumn("_read", read)
    rows = rows.withColumn("_chosen", chosen(F.col("_read")))
    body, number = F.col("_chosen.body"), F.col("_number")
    home = F.when(F.length(body).between(2, 17), F.concat(F.lit("+"), F.col("_plan.calling_code"), body))
    foreign = F.when(F.col("_plan").isNull() & F.col("_abroad") & F.length(number).between(4, 18), number)
    phone = F.struct(
        F.coalesce(home, foreign).alias("e164"), F.coalesce(home.isNotNull() & F.col("_chosen.ok"), F.lit(False)).alias("valid"),
        F.when(home.isNotNull(), F.col("_plan.iso2")).alias("country"))
    return rows.select("_raw", "_iso", phone.alias("_phone"))


def standardize_phones(rows: DataFrame, plans: DataFrame, phone: str = "phone_raw", iso: str = "country_iso", into: str = "phone") -> DataFrame:
    """Adds `into`: struct<e164, valid, country> of the number in `phone`, read from the country in `iso`."""
    keyed = rows.drop(into).withColumns({"_raw": F.col(phone), "_iso": F.coalesce(F.col(iso), F.lit(""))})
    numbers = keyed.select("_raw", "_iso").where(F.col("_raw").isNotNull()).distinct()
    done = settle(_worked_out(numbers, plans), "phones")
    none = F.struct(F.lit(None).cast("string").alias("e164"), F.lit(False).alias("valid"), F.lit(None).cast("string").alias("country"))
    return lookup_join(keyed, done, ["_raw", "_iso"]).withColumn(into, F.coalesce("_phone", none)).drop("_raw", "_iso", "_phone")
