"""Task files, progress logs and record stores as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entiform import fixed, schemas
from entiform.functions.text import trim
from entiform.operators.leads import with_reject_reasons
from entiform.operators.ordering import keep_per_key


def read_task_lists(spark: SparkSession, *paths: str) -> DataFrame:
    """(task_ord, path, input_name, city, country) from JSON files {city: {country, hotels: [...]}}.

    Order: file, then place in the file. A missing country, an empty name or a broken file is an error.
    """
    files = spark.read.text(list(paths), wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    parsed = files.withColumn("lists", F.from_json("value", schemas.TASK_LISTS))
    broken = F.raise_error(F.concat(F.lit("not a task file: "), F.col("path"))).cast(schemas.TASK_LISTS)
    cities = parsed.select("path", F.posexplode(F.map_entries(F.coalesce("lists", broken))).alias("c", "entry"))
    rows = cities.select(
        "path", "c", F.col("entry.key").alias("city"), F.col("entry.value.country").alias("country"),
        F.posexplode("entry.value.hotels").alias("h", "name"))
    wrong = (F.coalesce(F.length("country"), F.lit(0)) == 0) | (F.coalesce(F.length("name"), F.lit(0)) == 0)
    failed = F.raise_error(F.concat(F.lit("empty country or name under "), F.col("city"))).cast("string")
    # place in the input: file, city, name; each packed into its own range of one number
    placed = files.select("path").distinct().select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("bigint").alias("f"))
    order = F.col("f") * (1 << 42) + F.col("c").cast("bigint") * (1 << 21) + F.col("h")
    return rows.join(placed, "path").select(
        order.alias("task_ord"), "path", F.when(wrong, failed).otherwise(trim(F.col("name"))).alias("input_name"),
        "city", "country")


def _json_lines(spark: SparkSession, path: str, schema: str, good) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.schema(schema + ", _broken string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_broken").json(path)
    ok = F.col("_broken").isNull() & good
    return raw.filter(ok).drop("_broken"), raw.filter(~F.coalesce(ok, F.lit(False)))


def read_progress_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(last valid line per id, skipped lines) of a JSON-lines log whose lines carry `seq`."""
    lead = schemas.LEAD + ", seq bigint"
    readable, skipped = _json_lines(spark, path, lead, F.length("id") > 0)
    judged = with_reject_reasons(readable)
    valid = judged.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
    invalid = judged.filter(F.size("reject_reasons") > 0).select("id", F.col("reject_reasons"))
    rejected = skipped.select("id", F.array(F.lit("unreadable")).alias("reject_reasons")).unionByName(invalid)
    return keep_per_key(valid, "id", "seq", "last"), rejected


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that hold a JSON array; broken files and invalid items are dropped, the last per slug (by file, then place) stays."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    items = F.from_json("value", f"array<{schemas.RECORD_STRUCT}>")
    rows = files.select("_file", F.posexplode(items).alias("pos", "r")).select(F.struct("_file", "pos").alias("_place"), "r.*")
    needed = ("slug", "input_name", "name", "city", "country", "model", "enriched_at")
    valid = F.col("governance_confidence").between(0, 1) & F.col("status").isin(*fixed.RECORD_STATUSES) \
        & F.col("sources").isNotNull()
    for c in needed:
        valid = valid & F.col(c).isNotNull()
    return keep_per_key(rows.filter(valid), "slug", "_place", "last").drop("_place")
