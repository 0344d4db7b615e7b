"""Joins of many rows to facts by key, safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that are spread over SALTS parts: the heaviest ones. Any other key then holds less than one row in HOT_KEYS.
HOT_KEYS = 5_000
SALTS = 32


def _has_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()


def row_salt(df: DataFrame) -> Column:
    """One of SALTS parts for each row, the same whenever the row is worked out again."""
    return F.pmod(F.xxhash64(*[c for c in df.columns if not _has_map(df, c)]), F.lit(SALTS)).cast("int")


def heaviest(rows: DataFrame, on: list[str], n: int = HOT_KEYS) -> DataFrame:
    """The `n` keys that the most rows hold."""
    counted = rows.select(*on).dropna().groupBy(*on).agg(F.count("*").alias("_n"))
    return counted.orderBy(F.desc("_n"), *on).limit(n).select(*on)


def lookup_join(rows: DataFrame, facts: DataFrame, on: list[str], keys: DataFrame | None = None,
                weight: str | None = None, hot_keys: int = HOT_KEYS, parts: int | None = None) -> DataFrame:
    """Left join of `rows` to `facts`.

    The heaviest keys are sent to all tasks, keys alone and no more than `hot_keys`: their rows are spread over salts and
    their facts copied to each salt, as are rows without a key. Facts themselves are only broadcast if Spark finds them small.
    `weight` names a column of the facts that tells how many rows hold the key; without it the keys are counted in `keys`, or in the rows themselves.
    `parts`: tasks in which both sides meet, for wide facts; without it Spark's own number, which does not follow the rows.
    """
    if weight:
        top = facts.orderBy(F.desc(weight), *on).limit(hot_keys).select(*on)
    else:
        top = heaviest(rows if keys is None else keys, on, hot_keys)
    heavy = F.broadcast(top.withColumn("_heavy", F.lit(True)))
    keyless = F.lit(False)
    for c in on:
        keyless = keyless | F.col(c).isNull()
    salted = rows.join(heavy, on, "left").withColumn(
        "_salt", F.when(keyless | F.col("_heavy").isNotNull(), row_salt(rows)).otherwise(F.lit(0))).drop("_heavy")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    copied = facts.dropna(subset=on).join(heavy, on, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_heavy").isNotNull(), every).otherwise(F.array(F.lit(0))))).drop("_heavy")
    if parts:
        salted, copied = (side.repartition(parts, *on, "_salt") for side in (salted, copied))
    added = [c for c in facts.columns if c not in on]
    return salted.join(copied, [*on, "_salt"], "left").select(*rows.columns, *added)


def skip_done(todo: DataFrame, done: DataFrame, key: str = "id", force: bool = False) -> DataFrame:
    """Rows whose key is not finished yet; all rows with `force`."""
    if force:
        return todo
    flags = done.select(key).distinct().withColumn("_done", F.lit(True))
    return lookup_join(todo, flags, [key]).filter(F.col("_done").isNull()).drop("_done")


def union_restored(done: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Restored rows, then fresh rows that were not restored; `export_rank` 0 or 1 gives the order."""
    return done.withColumn("export_rank", F.lit(0)).unionByName(
        skip_done(fresh, done, key).withColumn("export_rank", F.lit(1)), allowMissingColumns=True)
