"""Helpers shared by the operators: stored tables, words, shingles, code shipped with a job."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entiform.functions.storage import Scratch

#: Words of one shingle, and the similarity from which two texts are near copies.
SHINGLE_WORDS = 5
NEAR = 0.8

_WORD = re.compile(r"\w+")
_HASH_KEY = "entiform-shingle"  # 16 bytes


def by_value(module: str) -> None:
    """Ship the functions of `module` with each job, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def share(spark: SparkSession, thing) -> Callable[[], object]:
    """Broadcast `thing` together with its code; a worker unpacks it once and keeps it for later tasks."""
    packed = spark.sparkContext.broadcast({"packed": cloudpickle.dumps(thing)})

    def get():
        held = packed.value
        if "thing" not in held:
            held["thing"] = cloudpickle.loads(held.pop("packed"))
        return held["thing"]

    return get


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared work folder and read it back: computed once, size known, safe from lost executors."""
    return Scratch(df.sparkSession, name).write(df, "rows")


def without(df: DataFrame, *names: str) -> DataFrame:
    """The input without columns that the result will replace; names are compared as Spark does, without case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def each(df: DataFrame, *kept: str, array: str | Column, into: str) -> DataFrame:
    """One row for each element of an array.

    A plain explode makes the optimizer filter empty arrays first, which computes the array a second time and pulls its inputs into its
    lambdas; the outer form with a filter behind it does not.
    """
    return df.select(*kept, F.explode_outer(array).alias(into)).where(F.col(into).isNotNull())


def checksum(column: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def words(text: str | None) -> list[str]:
    """Lower-case words of a text: runs of letters, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


def word_hashes(tokens: list[str]) -> np.ndarray:
    """Stable 64-bit hash of each word."""
    if not tokens:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(tokens, dtype=object), hash_key=_HASH_KEY, categorize=False)


def shingle_hashes(hashed: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text; a shorter text is one shingle of all its words."""
    n = len(hashed)
    if n == 0:
        return np.zeros(0, np.uint64)
    take = min(size, n)
    out = np.zeros(n - take + 1, np.uint64)
    for k in range(take):
        out = (out ^ hashed[k:n - take + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


by_value(__name__)
by_value("entiform.functions.storage")
