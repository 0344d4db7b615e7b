"""Chains over leads that arrive in batches.

Of each brand key the smallest and the largest city, the first label and the number of rows are kept; all of it merges, so a batch reads and
rewrites only the buckets of its own brands. A brand becomes a chain in the batch that brings its second city: from then on its earlier leads have
a chain as well. Leads are stored once, without it, and get it when they are read; which brands a batch has changed for earlier leads is a
table of its own, for those who hold copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from entiform import fixed
from entiform.functions.storage import Scratch, exists
from entiform.operators.chains import brand_spread, with_brand_keys, with_chains
from entiform.sources.record_store import RecordStore

BRAND_SCHEMA = "_brand string, lo string, hi string, _label string, _first bigint, _rows bigint"
CHANGE_SCHEMA = "brand string, label string, batch_id bigint"


class ChainIntake:
    """foreachBatch writer of leads (with `ord`); `read` gives them with the chains of all batches so far, as `detect_chains` would."""

    def __init__(self, folder: str, brands=fixed.KNOWN_BRANDS, buckets: int = 256):
        self.folder, self.brands = folder.rstrip("/"), brands
        self.state = RecordStore(f"{self.folder}/brands", BRAND_SCHEMA, "_brand", buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{self.folder}/leads/batch_id={batch_id}"
        if self.state.stored(spark, batch_id):
            return
        with_brand_keys(batch, self.brands).write.mode("overwrite").parquet(target)
        scratch = Scratch(spark, f"chains-{batch_id}")
        found = scratch.write(brand_spread(spark.read.parquet(target)).withColumn("_first", F.col("_first").cast("bigint")), "found")
        known = self.state.lookup(found).select("_brand", F.struct("lo", "hi", "_label", "_first", "_rows").alias("old"))
        both = found.join(known, "_brand", "left")
        old = F.col("old")
        earlier = old.isNotNull() & (old["_first"] <= F.col("_first"))
        merged = scratch.write(both.select(
            "_brand", F.least("lo", old["lo"]).alias("lo"), F.greatest("hi", old["hi"]).alias("hi"),
            F.when(earlier, old["_label"]).otherwise(F.col("_label")).alias("_label"), F.least("_first", old["_first"]).alias("_first"),
            (F.col("_rows") + F.coalesce(old["_rows"], F.lit(0))).alias("_rows"), "old"), "merged")
        was = F.when(old["lo"] != old["hi"], old["_label"])
        now = F.when(F.col("lo") != F.col("hi"), F.col("_label"))
        changed = merged.where(old.isNotNull() & ~now.eqNullSafe(was)).select(F.col("_brand").alias("brand"), now.alias("label"))
        changed.write.mode("overwrite").parquet(f"{self.folder}/changes/batch_id={batch_id}")
        # The state comes last: once it holds the batch, leads and changes are complete.
        if merged.limit(1).count():
            self.state.upsert(merged.drop("old"), batch_id)
        scratch.drop()

    def start(self, leads: DataFrame, available_now: bool = True) -> StreamingQuery:
        """Start the query on a stream of leads; its progress is kept in the same folder."""
        writer = leads.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def read(self, spark: SparkSession) -> DataFrame:
        """All leads with their chain."""
        leads = spark.read.option("basePath", f"{self.folder}/leads").parquet(f"{self.folder}/leads").drop("batch_id")
        return with_chains(leads, self.state.read(spark).filter("lo <> hi").select("_brand", "_label", "_rows"))

    def changes(self, spark: SparkSession) -> DataFrame:
        """(brand, label, batch_id): brands whose earlier leads have another chain since that batch."""
        if not exists(spark, f"{self.folder}/changes"):
            return spark.createDataFrame([], CHANGE_SCHEMA)
        return spark.read.schema(CHANGE_SCHEMA).parquet(f"{self.folder}/changes")
