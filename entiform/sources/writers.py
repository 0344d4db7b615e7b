"""Delivery files and the progress log."""

from __future__ import annotations

import hashlib
import os.path
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entiform import fixed
from entiform.functions.storage import exists
from entiform.operators.leads import contacts_table, flatten_leads
from entiform.operators.ordering import keep_per_key

_FORMATS = ("json", "csv", "excel")
_EXTENSIONS = {".json": "json", ".csv": "csv", ".xlsx": "excel"}
BYTE_ORDER_MARK = "﻿"


def resolve_format(path: str, explicit: str | None = None) -> str:
    """The explicit format, else by file extension, else `excel`."""
    if explicit in _FORMATS:
        return explicit
    return _EXTENSIONS.get(os.path.splitext(path)[1].lower(), "excel")


def write_json(leads: DataFrame, path: str) -> None:
    """One lead per line, in part files."""
    leads.write.mode("overwrite").json(path)


def write_csv(leads: DataFrame, path: str) -> None:
    """Delivery columns with `;`, readable headers and a byte order mark in every part file."""
    flat = flatten_leads(leads)
    headers = [h for _, h in fixed.FLAT_COLUMNS]
    headers[0] = BYTE_ORDER_MARK + headers[0]
    flat.toDF(*headers).write.mode("overwrite").csv(
        path, sep=";", header=True, escape='"', emptyValue="", encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_workbook_tables(leads: DataFrame, path: str) -> None:
    """The two tables of the workbook: establishments and contacts."""
    flatten_leads(leads).write.mode("overwrite").parquet(f"{path}/establishments")
    contacts_table(leads).write.mode("overwrite").parquet(f"{path}/contacts")


def write_entities(leads: DataFrame, path: str, fmt: str | None = None) -> str:
    """Write leads in the resolved format; returns that format."""
    chosen = resolve_format(path, fmt)
    {"json": write_json, "csv": write_csv, "excel": write_workbook_tables}[chosen](leads, path)
    return chosen


def run_signature(*parts: str) -> str:
    """Short hash of what defines a run."""
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:12]


def progress_path(folder: str, output: str, signature: str) -> str:
    """Folder of a run's progress: readable part of the output name and the run signature."""
    base = re.sub("[^a-zA-Z0-9]+", "-", output).strip("-")[-40:] or "run"
    return f"{folder.rstrip('/')}/{base}/signature={signature}"


def append_progress(leads: DataFrame, path: str, batch_id: int) -> None:
    """Store the leads finished by one batch; a repeated batch replaces its own rows only."""
    leads.withColumn("seq", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
        f"{path}/batch_id={batch_id}")


def load_progress(spark: SparkSession, path: str) -> DataFrame | None:
    """Last stored state of each lead; None when nothing is stored."""
    if not exists(spark, path):
        return None
    stored = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path)
    return keep_per_key(stored, "id", "seq", "last").drop("batch_id", "seq")


def clear_progress(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
