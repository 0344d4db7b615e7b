"""Connected classes of linked nodes, and the rows of the nodes' members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiform.functions.storage import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of `edges` (a, b): the smallest node that they reach.

    Large-star and small-star rounds until nothing changes: every round hangs the neighbours of a node on its smallest one. Rounds are
    written to the work folder; the driver sees a count and a checksum of each.
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


def classes(nodes: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, class_id, class_key, n_links) of the linked nodes.

    `nodes` has (key, first_id, copies), `links` (key, n): members of other nodes that a node is linked with, in parts. The class takes the
    smallest id of its members, and its first node by id.
    """
    rooted = components(edges).join(nodes, F.col("node") == F.col("key"))
    heads = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("late"), F.col("first_id").alias("id"), F.col("key").alias("key"))).alias("head"))
    total = links.groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("n_links"))
    return (rooted.select("key", "root").join(heads, "root").join(total, F.col("key") == F.col("k"))
            .select("key", F.col("head.id").alias("class_id"), F.col("head.key").alias("class_key"), "n_links"))


def members(rows: DataFrame, nodes: DataFrame, linked: DataFrame, name: str) -> DataFrame:
    """(name, key, class_id, class_key, first_id, n_links) of each row (name, key); a row without a key is a class of its own."""
    known = nodes.join(linked.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left").select(
        F.col("key").alias("k"), F.when(F.col("class_key").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_key", "key").alias("class_key"), "first_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.join(known, F.col("key") == F.col("k"), "left").select(
        name, "key", F.when(F.col("key").isNull(), F.col(name)).otherwise(F.col("class_id")).alias("class_id"), "class_key",
        F.when(F.col("key").isNull(), F.col(name)).otherwise(F.col("first_id")).alias("first_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
