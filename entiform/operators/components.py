"""Connected components of linked nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiform.functions.storage import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of `edges` (a, b): the smallest node that they reach.

    Large-star and small-star rounds until nothing changes: every round hangs the neighbours of a node on its smallest one, so a long way
    shrinks by a share of its length each time. Rounds are written to the work folder; the driver sees a count and a checksum of each.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.write(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    state, k = None, 0
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (seen["n"], seen["x"]) == state or not seen["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state, k = (seen["n"], seen["x"]), k + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u"))
        now = scratch.write(
            small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), f"edges-{k}")
        if k > 1:
            scratch.drop(f"edges-{k - 2}")
