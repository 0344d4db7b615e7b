"""Leads from a stream, deduplicated against everything accepted before.

Results lie under one shared folder, one `batch_id=<n>` part per micro-batch; a batch overwrites its own part. What later batches ask
for, owners of keys and finished ids, lies in a `KeyStore`: a batch sees only what smaller batches stored, so a replayed one gives the same
result, and it reads only the buckets that its own keys may be in, so its cost does not follow the length of the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from entiform import fixed
from entiform.functions.storage import Scratch
from entiform.operators.dedup import decide, entity_keys, key_counts, resolve_owners, with_owner_ids, without_owned
from entiform.operators.leads import normalize_leads, parse_places, with_reject_reasons
from entiform.operators.lookups import skip_done
from entiform.plans.stages import Stage, run_stages
from entiform.streaming.state import KeyStore

OWNER_SCHEMA = "signal int, key string, owner_ord bigint, owner_id string"


def stream_leads(places: DataFrame, country: str = fixed.DEFAULT_COUNTRY) -> DataFrame:
    """Listings of a stream to normalised leads with `reject_reasons`; stateless. A batch of few files is dealt out over all cores first."""
    dealt = places.repartition(2 * places.sparkSession.sparkContext.defaultParallelism)
    return with_reject_reasons(normalize_leads(parse_places(dealt, country), country))


def _store(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


class LeadIntake:
    """foreachBatch writer: validates, deduplicates and stores leads, rejects, decisions and statistics."""

    def __init__(self, folder: str, fanout: int = 8, bucket_rows: int = 200_000):
        self.folder = folder.rstrip("/")
        self.owners = KeyStore(self.path("owners"), OWNER_SCHEMA, ("signal", "key"), fanout, bucket_rows)

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        scratch = Scratch(spark, f"intake-{batch_id}")
        seen = Observation()
        judged = scratch.write(
            batch.observe(
                seen, F.count("*").alias("received"),
                F.count_if(F.size("reject_reasons") > 0).alias("invalid")),
            "judged")
        leads = judged.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
        keys = scratch.write(entity_keys(leads), "keys")
        # Rows that hit an owner of an earlier batch are decided, whatever their order: what has arrived before wins.
        # The rest compete among themselves.
        self.owners.merge(spark, batch_id)
        counts = scratch.write(key_counts(keys), "counts")
        known = scratch.write(self.owners.lookup(counts, batch_id, scratch), "known")
        fresh = without_owned(keys, known.select("signal", "key", "n"))
        new = scratch.write(with_owner_ids(resolve_owners(fresh, scratch), keys).drop("n"), "new")
        self.owners.put(new.select("signal", "key", "owner_ord", "owner_id"), batch_id)
        owners = known.select("signal", "key", F.lit(-1 << 62).alias("owner_ord"), "owner_id").unionByName(
            new.select("signal", "key", "owner_ord", "owner_id"))
        _store(decide(keys, owners), self.path("decisions"), batch_id)
        decisions = spark.read.parquet(f"{self.path('decisions')}/batch_id={batch_id}")
        _store(leads.join(decisions.filter("NOT duplicate").select("ord"), "ord", "left_semi"),
               self.path("leads"), batch_id)
        _store(judged.filter(F.size("reject_reasons") > 0), self.path("rejects"), batch_id)
        counts = decisions.agg(
            F.count_if("duplicate").alias("duplicates"), F.count_if(~F.col("duplicate")).alias("accepted"))
        _store(counts.select(
            F.lit(seen.get["received"]).cast("bigint").alias("received"),
            F.lit(seen.get["invalid"]).cast("bigint").alias("invalid"), "duplicates", "accepted"),
            self.path("stats"), batch_id)
        scratch.drop()

    def start(self, leads: DataFrame, available_now: bool = True) -> StreamingQuery:
        """Start the query on the output of stream_leads; its progress is kept in the same folder."""
        writer = leads.writeStream.foreachBatch(self).option("checkpointLocation", self.path("checkpoint"))
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(self.path(table)).drop("batch_id")

    def stats(self, spark: SparkSession) -> DataFrame:
        """One row of totals over all batches."""
        names = ("received", "invalid", "duplicates", "accepted")
        return self.read(spark, "stats").agg(*[F.sum(n).alias(n) for n in names])


def incremental_enrichment(folder: str, stages: Iterable[Stage], tables: Mapping[str, DataFrame]
                           ) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that enriches only leads no earlier batch has attempted."""
    stages = list(stages)
    path = f"{folder.rstrip('/')}/enriched"
    done = KeyStore(f"{folder.rstrip('/')}/enriched-ids", "id string", ("id",))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        scratch = Scratch(spark, f"enrich-{batch_id}")
        leads = scratch.write(batch, "batch")
        ids = scratch.write(leads.select("id").where("id IS NOT NULL").distinct(), "ids")
        done.merge(spark, batch_id)
        finished = scratch.write(done.lookup(ids, batch_id, scratch), "finished")
        _store(run_stages(skip_done(leads, finished), stages, tables, scratch), path, batch_id)
        done.put(scratch.write(ids.join(finished, "id", "left_anti"), "new-ids"), batch_id)
        scratch.drop()

    return write
