"""Documents that contain benchmark items, found by size-partitioned MinHash containment search.

All native. Items are short and documents may be very long, so similarity of whole sets says nothing; what counts is containment, the share of
an item's word shingles that the document has. The items are partitioned by size. In a partition whose largest item has u shingles, each item is
sketched by its bottom-k MinHash, the k smallest shingle hashes, with k = u - ceil(t u) + 1: an item with t of its shingles in a document
misses fewer than k of them, so the document holds at least one of the k. The search loses nothing, and k grows with the size of the items
only. Candidates are verified by exact containment over all shingles.

The sketches are broadcast while their number is small (it is checked), else joined by shuffle. Equal shingles of one document are looked
up once. A shingle is five words in lower case; a shorter item is one shingle of all its words. Documents are also cut into shingles of each
length that such an item has, so short items are found inside long documents too.

Null or empty texts hold nothing. Items without words are in no document. For `contained`, rows with equal document ids, or null ones, count
as one document with the shingles of all of them, and likewise rows with equal item ids; `clean` judges each row by its own text. An empty
table on either side gives no matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform.llm.common import NEAR, SHINGLE_WORDS, each, settle

#: Rows of a sketch that are sent to all executors at most (a row is a few dozen bytes).
BROADCAST_ROWS = 200_000


def word_array(text: Column) -> Column:
    """Runs of letters, marks, numbers and underscores in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def shingles(words: Column, lengths: tuple[int, ...] = (), size: int = SHINGLE_WORDS) -> Column:
    """Distinct hashes of the word shingles of `size` words, and of runs of each of the shorter `lengths`."""
    none = F.array().cast("array<bigint>")
    many = F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))).otherwise(none)
    short = [F.when(F.size(words) >= n, _runs(words, n)).otherwise(none) for n in lengths]
    return F.array_distinct(F.concat(many, *short))


def _runs(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])))


def _run_hash(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def shingled(df: DataFrame, name: str, text: str, lengths: tuple[int, ...] = ()) -> DataFrame:
    """(name, sh): the distinct shingles of each row. The words are a column of their own, so that they are taken out of a text once."""
    words = df.select(name, word_array(F.col(text)).alias("words"))
    return words.select(name, shingles(F.col("words"), lengths).alias("sh"))


def _items(items: DataFrame, item: str, text: str) -> tuple[DataFrame, tuple[int, ...]]:
    """((item, sh) of each row, lengths of the items that are shorter than a shingle)."""
    words = settle(items.select(F.col(item).alias("item"), word_array(F.col(text)).alias("words")), "benchmark-words")
    short = words.where(F.size("words").between(1, SHINGLE_WORDS - 1)).agg(F.collect_set(F.size("words")).alias("n")).first()["n"]
    return words.select("item", F.when(F.size("words").between(1, SHINGLE_WORDS - 1), F.array(_run_hash(F.col("words")))).otherwise(shingles(F.col("words"))).alias("sh")), tuple(sorted(short))


def _sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item, h) of each item's bottom-k MinHash, k by its partition of sizes."""
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))))  # sizes up to 1, 2, 4, 8, ... make one partition each
    k = F.least(F.col("n"), (upper - F.ceil(F.lit(threshold) * upper - 1e-9) + 1).cast("int"))
    return items.select("item", F.explode(F.slice(F.array_sort("sh"), F.lit(1), k)).alias("h"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = NEAR, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item, n_shared, n_shingles, containment) for each item of which a document holds at least `threshold` of the shingles."""
    cut, lengths = _items(items, item, text)
    prepared = each(cut, "item", array="sh", into="h").groupBy("item").agg(F.collect_set("h").alias("sh"))
    prepared = settle(prepared.withColumn("n", F.size("sh")), "benchmark-items")
    sketch = settle(_sketches(prepared, threshold).groupBy("h").agg(F.collect_set(F.struct("item")).alias("items")), "benchmark-sketches")
    small = F.broadcast if sketch.count() <= BROADCAST_ROWS else (lambda df: df)
    own = docs.select(F.col(doc).alias("doc"), F.col(text).alias("body")).where(F.col("body").isNotNull())
    probes = each(shingled(own, "doc", "body", lengths), "doc", array="sh", into="h")
    found = settle(probes.join(small(sketch), "h").select("doc", F.explode("items").alias("of")).select("doc", "of.item").distinct(), "benchmark-candidates")
    suspects = found.select("doc").distinct().withColumnRenamed("doc", "suspect")
    again = own.join(suspects, F.col("doc").eqNullSafe(F.col("suspect")), "left_semi")
    checked = each(shingled(again, "doc", "body", lengths), "doc", array="sh", into="h")
    wanted = prepared.select("item", F.explode("sh").alias("h"))
    listed = wanted.groupBy("h").agg(F.collect_set(F.struct("item")).alias("items"))
    listed = F.broadcast(listed) if wanted.count() <= BROADCAST_ROWS else listed
    shared = (checked.join(listed, "h").select("doc", "h", F.explode("items").alias("of")).select("doc", "h", "of.item").distinct()
              .groupBy("doc", "item").agg(F.count("*").alias("n_shared")))
    pairs = found.withColumnsRenamed({"doc": "d", "item": "i"})
    kept = shared.join(pairs, F.col("doc").eqNullSafe(F.col("d")) & F.col("item").eqNullSafe(F.col("i")), "left_semi")
    sizes = prepared.select(F.col("item").alias("i"), F.col("n").cast("long").alias("n_shingles"))
    return (kept.join(sizes, F.col("item").eqNullSafe(F.col("i")))
            .where(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles"))
            .select(F.col("doc").alias(doc), F.col("item").alias(item), "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")))


def clean(docs: DataFrame, items: DataFrame, threshold: float = NEAR, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """The rows whose text holds no item. A row is known by 128 bits of hash of its id and text, so rows that share an id, or have none, are
    judged apart."""
    row = F.struct(F.xxhash64(F.col(doc), F.col(text)).alias("a"), F.xxhash64(F.lit(7), F.col(doc), F.col(text)).alias("b"))
    found = contained(docs.select(row.alias("__row"), F.col(text).alias("__text")), items.select(F.col(item), F.col(text).alias("__text")), threshold, "__row", item, "__text")
    bad = settle(found.select(F.col("__row").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, row == F.col("__bad"), "left_anti")
