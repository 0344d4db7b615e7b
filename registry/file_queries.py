"""Queries that write files with the library's writers and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from entiform.functions.storage import Scratch, settle
from entiform.operators import chains, ordering
from entiform.sources import writers
from entiform.sources.record_store import RecordStore
from entiform.streaming.chains import ChainIntake
from registry import lead_queries as leads_of
from registry import record_queries as records_of
from registry.dialect import LEADS, RAW, with_


def write_json(spark, d):
    leads, path = leads_of._leads(spark, d), f"{Scratch(spark, 'json').path}/leads"
    writers.write_json(leads, path)
    return spark.read.schema(leads.schema).json(path).select(*leads_of._LEAD_COLS)


def workbook_contacts(spark, d):
    path = Scratch(spark, "workbook").path
    writers.write_entities(chains.detect_chains(leads_of._valid(spark, d)), path, "excel")
    return spark.read.parquet(f"{path}/contacts").withColumn("pos", F.col("pos").cast("bigint"))


def progress_log(spark, d):
    """All leads as collected, then some of them again as enriched: the last state of each lead counts."""
    leads, path = leads_of._leads(spark, d), f"{Scratch(spark, 'progress').path}/log"
    leads = settle(leads.withColumn("id", F.concat(F.lit("k"), F.col("ord").cast("string"))), "leads")
    writers.append_progress(leads.withColumn("source", F.lit("collected")), path, 0)
    writers.append_progress(leads.filter("ord % 3 = 0").withColumn("source", F.lit("enriched")), path, 1)
    return writers.load_progress(spark, path).select("ord", "id", "source", "company_name")


def record_store(spark, d):
    """Stored records, then new ones over them, bucket by bucket; read back with what became of each key."""
    old = records_of._stored(spark, d)
    store = RecordStore(f"{Scratch(spark, 'records').path}/store", old.schema, buckets=16)
    store.upsert(old, 0)
    new = ordering.dedup_by_slug(records_of._records(spark, d).filter("task_ord % 3 <> 0 OR task_ord % 2 = 0"), force=True)
    told = store.upsert(new.drop("task_ord").select(*[F.col(f.name).cast(f.dataType) for f in old.schema]), 1)
    return store.read(spark).join(told, "slug", "left").select("slug", "input_name", "model", F.coalesce("outcome", F.lit("kept")).alias("outcome"))


def stream_chains(spark, d):
    """The listings as ordered files, one micro-batch per file: chains as of the last one."""
    scratch = Scratch(spark, "chains")
    leads = leads_of._leads(spark, d)
    step = leads.agg(F.max("ord")).first()[0] / 4
    ranged = scratch.write(leads.withColumn("part", F.least(F.lit(3), F.floor(F.col("ord") / F.lit(step)).cast("int"))), "ranged")
    for i in range(4):
        ranged.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{scratch.path}/in")
    intake = ChainIntake(f"{scratch.path}/out", buckets=16)
    intake.start(spark.readStream.schema(leads.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch.path}/in")).awaitTermination()
    return intake.read(spark).select("ord", "company_name", "city", F.col("chain.is_chain").alias("is_chain"), F.col("chain.name").alias("chain_name"))


QUERIES = {f.__name__: f for f in (write_json, workbook_contacts, progress_log, record_store, stream_chains)}
ORACLES = {
    "write_json": leads_of.ORACLES["normalize_leads"],
    "workbook_contacts": leads_of.ORACLES["contacts_table"],
    "record_store": records_of.ORACLES["upsert_by_key"],
    "stream_chains": leads_of.ORACLES["detect_chains"],
    "progress_log": with_(RAW, LEADS, views=("places_v",)) +
    "SELECT ord, 'k' || ord AS id, CASE WHEN ord % 3 = 0 THEN 'enriched' ELSE 'collected' END AS source, company_name FROM leads",
}
