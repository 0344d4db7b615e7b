"""Cleaning of a document corpus in five stages; each is written as Parquet and read again before the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of their input. Null ids and texts, repeated
rows and empty tables go through: what a stage cannot judge stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entiform.functions.storage import Scratch
from entiform.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from entiform.llm.common import table, without

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.score(docs, model, into=("__score", "__toxic", "__hits"))
    return judged.where(F.col("__toxic") == 0).select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs)
    cut = F.col("lines_dropped") > 0
    counted = {"n_chars": F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return out.withColumns(counted).select([c for c in docs.columns if c != "lines_dropped"])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and the number of these."""
    encoded = bpe.encode(without(docs, "token_ids", "n_tokens"), TOKENIZER)
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near copies", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("tokens", tokenize),
]
#: Learned scores and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        scratch = Scratch(spark, "stage-" + name.replace(" ", "-"))
        docs = scratch.write(stage(spark, docs, sf_dir), "rows")
        if before:
            before.drop()
        before = scratch
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
