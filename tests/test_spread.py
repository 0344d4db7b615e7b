"""Steps that cost much for each row are dealt out, and none is worked out twice."""

from pyspark.sql import functions as F

from entiform.functions import storage
from entiform.functions.storage import spread
from entiform.operators import chains, leads as L
from registry.views import view


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_file_is_several_tasks(spark, tmp_path):
    rows = spark.range(6_000).select(
        F.when(F.col("id") != 7, F.col("id")).alias("c_custkey"), F.lit("A").alias("c_mktsegment"), (F.col("id") % 25).cast("int").alias("c_nationkey"))
    rows.unionByName(rows.filter("c_custkey = 1")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name, times in (("places_v", 1), ("site_pages_v", 4)):
        got = view(spark, str(tmp_path), name)
        assert got.rdd.getNumPartitions() > 1 and got.count() == 6_001 * times


def test_spread_grows_with_the_rows(spark, monkeypatch):
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 10)
    assert spread(spark.range(2_000, numPartitions=1)).rdd.getNumPartitions() == 200


def leads(spark):
    raw = spark.range(3).select(
        F.col("id").alias("ord"), F.lit("s").alias("source"), F.lit("Hotel Onomo").alias("company_name"), F.lit("Douala").alias("city"),
        F.when(F.col("id") == 1, F.lit("")).otherwise(F.lit("+237 699 00 00 00")).alias("phone_raw"), F.when(F.col("id") == 2, 7.0).alias("google_rating"))
    return L.normalize_leads(raw)


def test_normalised_once(spark):
    valid, rejects = L.validate_leads(leads(spark))
    assert [r.ord for r in valid.orderBy("ord").collect()] == [0, 1] and [r.ord for r in rejects.collect()] == [2]
    assert "regexp_replace" not in plan(valid) + plan(rejects)
    assert "rlike" not in plan(chains.detect_chains(valid)).lower()
