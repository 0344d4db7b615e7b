"""Boilerplate lines: lines that a large share of a site's pages contain are cut out of its pages.

All native. Per host, the pages that contain a line are divided by the pages of the host; lines above the ratio go. A page counts once
for a line that it repeats. A line must also stand on `min_pages` pages, so that hosts with few pages lose nothing by chance. Lines are
compared as they stand, blanks at both ends aside; blank lines always stay. They are counted by 128 bits of hash, combined
within each task before anything is shuffled, so a line on a third of all pages is no hot key. The lines of the `HOT_HOSTS` largest hosts are
broadcast, so their pages stay where they are; any other host holds less than one page in `HOT_HOSTS`, and its pages meet its lines by host.

Null texts stay null and count as a page; an empty text stays. Rows with a null host are one host. Rows with the same or a null id are
kept and judged one by one. An empty table gives no rows; a column lines_dropped is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform.llm.common import each, settle, without

#: Hosts whose lines go to all tasks: the largest ones.
HOT_HOSTS = 1_000


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int, host: str = "source", text: str = "text") -> DataFrame:
    """(host, pages, cut): hashes of the lines that at least `ratio` of the host's pages contain.

    A host has at most (its distinct lines per page) / `ratio` of them, so the array is bounded.
    """
    named = pages.select(F.col(host).cast("string").alias("host"), F.col(text).alias("body"))
    lines = F.array_distinct(F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    seen = each(named, "host", array=lines, into="line").groupBy("host", _hash(F.col("line")).alias("line")).agg(F.count("*").alias("on_pages")).where(F.col("on_pages") >= min_pages)
    totals = named.groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("pages"))
    return (seen.join(totals, F.col("host").eqNullSafe(F.col("of_host"))).where(F.col("on_pages") >= F.lit(ratio) * F.col("pages"))
            .groupBy("host", "pages").agg(F.collect_list("line").alias("cut")))


def _named(host: Column) -> Column:
    """The host as a key that is never null."""
    return F.when(host.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), host.cast("string")))


def drop_boilerplate(docs: DataFrame, ratio: float = 0.05, min_pages: int = 5, host: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rewrite `text` without boilerplate lines and add `lines_dropped`."""
    docs = without(docs, "lines_dropped")
    cuts = settle(boilerplate(docs, ratio, min_pages, host, text), "boilerplate")
    cuts = cuts.select(_named(F.col("host")).alias("__host"), F.col("cut").alias("__cut"), "pages")
    large = cuts.orderBy(F.desc("pages"), "__host").limit(HOT_HOSTS).select("__host", F.col("__cut").alias("__large"))
    small = cuts.join(F.broadcast(large.select("__host")), "__host", "left_anti").drop("pages")
    joined = docs.withColumn("__host", _named(F.col(host))).join(F.broadcast(large), "__host", "left")
    # Pages whose lines are here already ask for nothing more, and are spread by their id.
    joined = joined.withColumn("__host", F.when(F.col("__large").isNull(), F.col("__host")).otherwise(F.xxhash64(F.col(key).cast("string"), F.col(text)).cast("string")))
    joined = joined.join(small, "__host", "left").withColumn("__cut", F.coalesce("__large", "__cut"))
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains("__cut", _hash(F.trim(x))))
    touched = joined.withColumn("__kept", F.when(F.col("__cut").isNotNull(), kept))
    return touched.withColumns({
        text: F.when(F.col("__kept").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n")),
        "lines_dropped": F.when(F.col("__kept").isNull(), 0).otherwise(F.size(lines) - F.size("__kept")).cast("long")}).select(*docs.columns, "lines_dropped")
