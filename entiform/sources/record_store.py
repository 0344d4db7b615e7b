"""Records stored by key in hash buckets; an upsert rewrites only the buckets that its keys fall into.

A bucket is a folder `data/version=<n>/bucket=<b>`. A commit `commits/<n>` lists the version of every bucket, so readers see one state: the
newest complete commit. An upsert writes new versions of its buckets first and its commit last; what a failed one leaves counts for nothing
and is written over by the next. A commit's name holds the id of its batch: a batch that was stored already is not stored again.

One writer at a time. The number of buckets belongs to the store and is as large as keeps a bucket small; `rebucket` deals all records out anew.
A null key never equals another, so each such row is a new record.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entiform.functions.storage import Scratch, children, exists, remove
from entiform.operators.records import upsert_by_key

_COMMIT = "buckets int, bucket int, version int"


class RecordStore:
    """Records of `schema` below one shared folder, unique by `key`."""

    def __init__(self, folder: str, schema: str, key: str = "slug", buckets: int = 256):
        self.folder, self.schema, self.key, self._first_buckets = folder.rstrip("/"), schema, key, buckets
        #: Buckets that the last upsert rewrote.
        self.touched: list[int] = []

    # ---- commits ----

    def _commits(self, spark: SparkSession) -> list[tuple[int, str]]:
        """(number, name) of all commits, complete or not, oldest first. A name is the number, and `_` with the batch if there is one."""
        names = children(spark, f"{self.folder}/commits")
        return sorted((int(n.split("_")[0]), n) for n in names if n[0].isdigit())

    def _complete(self, spark: SparkSession, name: str) -> bool:
        return exists(spark, f"{self.folder}/commits/{name}/_SUCCESS")

    def commits(self, spark: SparkSession) -> list[str]:
        """Names of the complete commits, oldest first."""
        return [name for _, name in self._commits(spark) if self._complete(spark, name)]

    def stored(self, spark: SparkSession, batch: str | int) -> bool:
        """Whether this batch was stored. Only names are listed, whatever the number of commits."""
        ending = "_" + quote(str(batch), safe="")
        return any(name == f"{n}{ending}" and self._complete(spark, name) for n, name in self._commits(spark))

    def _state(self, spark: SparkSession) -> tuple[int, int, dict[int, int]]:
        """(commit, number of buckets, version of each bucket that holds records)."""
        newest = next(((n, name) for n, name in reversed(self._commits(spark)) if self._complete(spark, name)), None)
        if newest is None:
            return 0, self._first_buckets, {}
        rows = spark.read.schema(_COMMIT).parquet(f"{self.folder}/commits/{newest[1]}").collect()
        return newest[0], rows[0]["buckets"], {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}

    def _commit(self, spark: SparkSession, number: int, buckets: int, versions: dict[int, int], batch: str | int | None) -> None:
        rows = [(buckets, b, v) for b, v in sorted(versions.items())] or [(buckets, None, None)]
        name = str(number) if batch is None else f"{number}_{quote(str(batch), safe='')}"
        spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{name}")

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("int")

    # ---- reading ----

    def _read(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(self.schema).parquet(*paths)

    def read(self, spark: SparkSession) -> DataFrame:
        """All records of the newest commit."""
        return self._read(spark, self._state(spark)[2])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The records of these keys; only their buckets are opened."""
        spark = keys.sparkSession
        _, buckets, versions = self._state(spark)
        wanted = self._buckets_of(keys, buckets)
        found = self._read(spark, {b: v for b, v in versions.items() if b in wanted})
        return found.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _buckets_of(self, rows: DataFrame, buckets: int) -> set[int]:
        """Buckets of these rows: at most as many numbers as the store has buckets."""
        return {r["b"] for r in rows.select(self.bucket(buckets).alias("b")).distinct().collect()}

    # ---- writing ----

    def _write(self, rows: DataFrame, buckets: int, version: int) -> None:
        (rows.withColumn("bucket", self.bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", self.key)
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={version}"))

    def upsert(self, incoming: DataFrame, batch: str | int | None = None) -> DataFrame:
        """Store `incoming` (unique by key); gives its keys with `outcome`, created or updated. A batch stored before changes nothing and gives no row."""
        spark = incoming.sparkSession
        none = spark.createDataFrame([], self.schema).select(self.key, F.lit("").alias("outcome"))
        self.touched = []
        if batch is not None and self.stored(spark, batch):
            return none
        number, buckets, versions = self._state(spark)
        scratch = Scratch(spark, "upsert")
        new = scratch.write(incoming, "incoming")
        asked = self._buckets_of(new, buckets)
        if not asked:
            return none
        old = self._read(spark, {b: v for b, v in versions.items() if b in asked})
        merged = scratch.write(upsert_by_key(old, new, self.key), "merged")
        self._write(merged.select(*old.columns), buckets, number + 1)
        self._commit(spark, number + 1, buckets, {**versions, **{b: number + 1 for b in asked}}, batch)
        scratch.drop("incoming")
        self.touched = sorted(asked)
        return merged.where(F.col("outcome") != "kept").select(self.key, "outcome")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch writer of batches that hold a key once."""
        self.upsert(batch, batch_id)

    def rebucket(self, spark: SparkSession, buckets: int) -> None:
        """Deal all records out over another number of buckets."""
        number, _, versions = self._state(spark)
        rows = self._read(spark, versions)
        self._write(rows, buckets, number + 1)
        self._commit(spark, number + 1, buckets, {b: number + 1 for b in self._buckets_of(rows, buckets)}, None)

    def expire(self, spark: SparkSession, keep: int = 1) -> None:
        """Remove versions that none of the newest `keep` commits names. Commits stay, since they tell which batches are stored."""
        rows = spark.read.schema(_COMMIT).parquet(*[f"{self.folder}/commits/{n}" for n in self.commits(spark)[-keep:]])
        named = {(r["version"], r["bucket"]) for r in rows.where("bucket IS NOT NULL").distinct().collect()}
        for version in children(spark, f"{self.folder}/data"):
            v = int(version.removeprefix("version="))
            for b in [n for n in children(spark, f"{self.folder}/data/{version}") if n.startswith("bucket=")]:
                if (v, int(b.removeprefix("bucket="))) not in named:
                    remove(spark, f"{self.folder}/data/{version}/{b}")
