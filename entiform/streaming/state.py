"""Rows by key that a stream has stored, read at the cost of the batch that asks.

Each batch adds a segment. As soon as `fanout` segments of one level lie side by side they are merged into one of the next level, so n batches
leave a few segments for each power of `fanout`, and a row is rewritten once for each level. A segment deals its rows out over buckets by a hash
of the key, as many as keep a bucket small, and holds a Bloom filter for each bucket: 64-bit words of which a key sets four bits.

A lookup first asks the filters of the buckets that its own keys fall into, and then reads only the buckets of keys that pass. Neither
step lists, opens or plans a file of another bucket.

Rows carry the batch that stored them, and a lookup for batch n sees only rows of earlier ones, so a replayed batch sees what it saw at first,
also after later merges. A segment counts once its filters are complete; what it was merged from no longer counts then, and goes.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entiform.functions.storage import Scratch, children, exists, remove

#: Keys for each 64-bit word of a filter: 16 bits a key.
KEYS_PER_WORD = 4


class Segment(NamedTuple):
    """Rows of the batches `first` to `last`; its folder's name says all of it."""

    first: int
    last: int
    level: int
    rows: int
    buckets: int

    @property
    def name(self) -> str:
        return "-".join(map(str, self))

    @property
    def words(self) -> int:
        """Filter words of each bucket."""
        return -(-self.rows // (self.buckets * KEYS_PER_WORD)) or 1


class KeyStore:
    """Segments of rows with these key columns below one folder. `schema` is that of the rows, without `batch_id`."""

    def __init__(self, folder: str, schema: str, keys: tuple[str, ...], fanout: int = 8, bucket_rows: int = 200_000):
        self.folder, self.schema, self.keys = folder.rstrip("/"), schema, keys
        self.fanout, self.bucket_rows = fanout, bucket_rows
        self.last_lookup: dict[str, int] = {}

    # ---- segments ----

    def _all(self, spark: SparkSession) -> list[Segment]:
        names = children(spark, f"{self.folder}/filters")
        found = [Segment(*map(int, n.removeprefix("segment=").split("-"))) for n in names if n.startswith("segment=")]
        return [s for s in found if exists(spark, f"{self._path('filters', s)}/_SUCCESS")]

    def segments(self, spark: SparkSession) -> list[Segment]:
        """Complete segments that no other one has taken in, by batch."""
        every = self._all(spark)
        return sorted(s for s in every if not any(t.level > s.level and t.first <= s.first and s.last <= t.last for t in every))

    def _path(self, part: str, segment: Segment) -> str:
        return f"{self.folder}/{part}/segment={segment.name}"

    def _placed(self, df: DataFrame, buckets: Column, words: Column) -> DataFrame:
        """Adds the bucket, the filter word and the bits of each key."""
        bit = [F.expr(f"shiftleft(1L, CAST(pmod(shiftright(_bits, {6 * k}), 64) AS INT))") for k in range(4)]
        place = df.withColumns({"_hash": F.xxhash64(*self.keys), "_bits": F.xxhash64(F.lit(1), *self.keys)})
        return place.withColumns({
            "bucket": F.pmod("_hash", buckets), "_word": F.pmod(F.shiftright("_hash", 20), words),
            "_mask": reduce(lambda a, b: a.bitwiseOR(b), bit)}).drop("_hash", "_bits")

    def _write(self, rows: DataFrame, segment: Segment) -> None:
        """`rows` are stored and have `batch_id`. Filters come last: they make the segment count."""
        placed = self._placed(rows, F.lit(segment.buckets), F.lit(segment.words))
        (placed.drop("_word", "_mask").repartition("bucket").sortWithinPartitions("bucket", *self.keys)
         .write.mode("overwrite").partitionBy("bucket").parquet(self._path("rows", segment)))
        filters = placed.groupBy("bucket", F.col("_word").alias("word")).agg(F.bit_or("_mask").alias("bits"))
        # A word in each bucket, so that each has a file to read.
        every = rows.sparkSession.range(segment.buckets).select(F.col("id").alias("bucket"), F.lit(-1).cast("bigint").alias("word"), F.lit(0).cast("bigint").alias("bits"))
        (filters.unionByName(every).repartition("bucket").sortWithinPartitions("bucket", "word")
         .write.mode("overwrite").partitionBy("bucket").parquet(self._path("filters", segment)))

    def _drop(self, spark: SparkSession, segment: Segment) -> None:
        for part in ("filters", "rows"):
            remove(spark, self._path(part, segment))

    def _segment(self, first: int, last: int, level: int, rows: int) -> Segment:
        buckets = 1
        while buckets * self.bucket_rows < rows:
            buckets *= 2
        return Segment(first, last, level, rows, buckets)

    # ---- writing ----

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """Store the rows of a batch; `rows` is stored already, and its keys are new to the store. A replayed batch replaces its own rows."""
        spark = rows.sparkSession
        for s in self._all(spark):
            if s.level and s.first <= batch_id <= s.last:
                return  # replayed after a merge, which holds these rows
            if s.first == batch_id == s.last:
                self._drop(spark, s)
        n = rows.count()
        if n:
            self._write(rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")), self._segment(batch_id, batch_id, 0, n))

    def merge(self, spark: SparkSession, before: int) -> None:
        """Merge full levels of segments of batches before `before`, which are known to be committed."""
        for gone in set(self._all(spark)) - set(self.segments(spark)):
            self._drop(spark, gone)
        while True:
            held = [s for s in self.segments(spark) if s.last < before]
            level = next((k for k in sorted({s.level for s in held}) if sum(s.level == k for s in held) >= self.fanout), None)
            if level is None:
                return
            old = [s for s in held if s.level == level]
            new = self._segment(old[0].first, old[-1].last, level + 1, sum(s.rows for s in old))
            self._write(self._read(spark, "rows", [(s, None) for s in old]).drop("bucket", "segment"), new)
            for s in old:
                self._drop(spark, s)

    # ---- reading ----

    def _read(self, spark: SparkSession, part: str, wanted) -> DataFrame:
        """Rows or filters of (segment, buckets or None for all)."""
        fields = f"{self.schema}, batch_id bigint" if part == "rows" else "word bigint, bits bigint"
        paths = [p for s, buckets in wanted for p in ([self._path(part, s)] if buckets is None else [f"{self._path(part, s)}/bucket={b}" for b in buckets])]
        return spark.read.schema(f"{fields}, segment string, bucket bigint").option("basePath", f"{self.folder}/{part}").parquet(*paths)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All stored rows."""
        held = self.segments(spark)
        if not held:
            return spark.createDataFrame([], f"{self.schema}, batch_id bigint")
        return self._read(spark, "rows", [(s, None) for s in held]).drop("segment", "bucket")

    def _by_segment(self, held: list[Segment], asked: DataFrame) -> list[tuple[Segment, list[int]]]:
        """Buckets that `asked` (segment, bucket) names: no more than it has rows, or than there are buckets."""
        named = {r["segment"]: sorted(r["buckets"]) for r in asked.groupBy("segment").agg(F.collect_set("bucket").alias("buckets")).collect()}
        return [(s, named[s.name]) for s in held if s.name in named]

    def lookup(self, keys: DataFrame, before: int, scratch: Scratch, name: str = "lookup") -> DataFrame:
        """`keys` (stored, distinct) with the stored rows of earlier batches that have them; keys that no batch has stored give no row."""
        spark = keys.sparkSession
        held = [s for s in self.segments(spark) if s.first < before]
        self.last_lookup = {"segments": len(held), "filter_files": 0, "row_files": 0, "maybe": 0, "buckets": sum(s.buckets for s in held)}
        empty = spark.createDataFrame([], f"{self.schema}")
        if not held:
            return keys.join(empty, list(self.keys))
        at = F.explode(F.array(*[F.struct(F.lit(s.name).alias("segment"), F.lit(s.buckets).alias("_buckets"), F.lit(s.words).alias("_words")) for s in held]))
        probes = self._placed(keys.select(*self.keys, at.alias("_at")).select(*self.keys, "_at.*"), F.col("_buckets"), F.col("_words")).drop("_buckets", "_words")
        wanted = self._by_segment(held, probes)
        if not wanted:
            return keys.join(empty, list(self.keys))
        filters = self._read(spark, "filters", wanted).withColumnRenamed("word", "_word")
        maybe = scratch.write(
            probes.join(filters, ["segment", "bucket", "_word"]).where(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
            .select(*self.keys, "segment", "bucket"), f"{name}-maybe")
        passed = self._by_segment(held, maybe)
        self.last_lookup.update(filter_files=sum(len(b) for _, b in wanted), row_files=sum(len(b) for _, b in passed), maybe=maybe.count())
        if not passed:
            return keys.join(empty, list(self.keys))
        stored = self._read(spark, "rows", passed).where(F.col("batch_id") < before).drop("segment", "bucket", "batch_id")
        return keys.join(stored, list(self.keys))
