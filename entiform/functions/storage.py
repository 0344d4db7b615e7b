"""Tables written between rounds: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIR_SETTING = "spark.checkpoint.dir"


_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary folder only in local mode without that setting."""
    context = spark.sparkContext
    named = spark.conf.get(_DIR_SETTING, None) or context.getConf().get(_DIR_SETTING)
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError(f"set {_DIR_SETTING} to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        folder = tempfile.mkdtemp(prefix="entiform-")
        atexit.register(shutil.rmtree, folder, True)
        _local_dirs[context.applicationId] = folder
    return _local_dirs[context.applicationId]


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored under this path."""
    at, system = _located(spark, path)
    return system.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none where there is no such folder."""
    at, system = _located(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove what is stored under this path."""
    at, system = _located(spark, path)
    system.delete(at, True)


class Scratch:
    """Numbered tables of one run below the work folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Write `df` and return the stored table."""
        target = f"{self.path}/{table}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def read(self, *tables: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{t}" for t in tables])

    def drop(self, *tables: str) -> None:
        """Remove some tables, or all of them, once nothing reads them any more."""
        for name in [f"{self.path}/{t}" for t in tables] or [self.path]:
            remove(self.spark, name)


#: Rows of one task in steps that cost much for each row, and the rows from which a second task pays.
ROWS_PER_TASK = 20_000
FEW_ROWS = 1_000
#: Rows, and bytes of text, of one task in steps that sort, group or join whole rows; more and smaller tasks cost time where the expressions are long.
ROWS_MET = 60_000
BYTES_PER_TASK = 64 << 20


def tasks_for(df: DataFrame, texts: Sequence[str] = (), each: int = 1, most: int | None = None) -> int:
    """Number of tasks for these rows, of `most` rows (ROWS_MET). It follows their number and the length of the columns `texts`, so that no task grows with the table."""
    lengths = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts]
    rows, *sizes = df.agg(F.count("*") * each, *lengths).first()
    wide = 4 * df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(-(-rows // FEW_ROWS), wide), -(-rows // (most or ROWS_MET)), -(-sum(sizes) // BYTES_PER_TASK))


def spread(df: DataFrame, each: int = 1) -> DataFrame:
    """Rows dealt out evenly, for steps that cost much for each row: a table of few files is few tasks otherwise.

    `each`: rows that come out of one row, where a step makes several.

    A filter may be moved below this; where it costs much, store the table first.
    """
    parts = tasks_for(df, each=each, most=ROWS_PER_TASK)
    return df.repartition(parts) if parts > 1 else df


def settle(df: DataFrame, name: str) -> DataFrame:
    """Store a result that several later steps read, so that it is computed once."""
    return Scratch(df.sparkSession, name).write(df, "rows")
