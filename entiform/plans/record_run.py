"""Task names in, scored records out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform import fixed
from entiform.functions import names
from entiform.functions.storage import settle
from entiform.operators.answers import parse_record_answers
from entiform.operators.lookups import lookup_join, skip_done
from entiform.operators.records import match_existing, run_summary, to_records, upsert_by_key
from entiform.operators.ordering import dedup_by_slug

__all__ = ["open_tasks", "research_records", "run_summary", "store_records", "task_outcomes"]


def open_tasks(tasks: DataFrame, stored: DataFrame | None, force: bool = False) -> DataFrame:
    """Tasks with their slug that are not stored yet."""
    slugged = tasks.withColumn("slug", names.slug(F.col("input_name"), F.col("city")))
    return slugged if stored is None else skip_done(slugged, stored, "slug", force)


def research_records(tasks: DataFrame, answers: DataFrame, stored: DataFrame | None = None, model: str = "",
                     threshold: float = fixed.REVIEW_THRESHOLD, force: bool = False,
                     enriched_at: Column | None = None) -> DataFrame:
    """New records: open tasks joined with `answers(task_ord, answer, sources)`, one record per slug."""
    todo = open_tasks(tasks, stored, force).drop("slug").join(answers, "task_ord")
    good, _ = parse_record_answers(todo)
    return dedup_by_slug(to_records(good, model, threshold, enriched_at), force)


def store_records(stored: DataFrame, records: DataFrame) -> DataFrame:
    """The stored table after the upsert, with an outcome per row."""
    return upsert_by_key(stored, records.drop("task_ord"))


def task_outcomes(tasks: DataFrame, answers: DataFrame, stored: DataFrame, model: str = "",
                  threshold: float = fixed.REVIEW_THRESHOLD, force: bool = False) -> DataFrame:
    """(task_ord, result, status, outcome) of every task, input of run_summary."""
    slugged = tasks.withColumn("slug", names.slug(F.col("input_name"), F.col("city")))
    todo = skip_done(slugged, stored, "slug", force)
    good, _ = parse_record_answers(todo.drop("slug").join(answers, "task_ord"))
    found = match_existing(to_records(good, model, threshold), stored).select("task_ord", "status", "outcome")
    # A task is skipped when its slug is stored or an earlier task of this run has succeeded; failures block nothing.
    tried = settle(todo.select("task_ord", "slug").join(found, "task_ord", "left"), "tried")
    firsts = tried.filter(F.col("outcome").isNotNull()).groupBy("slug").agg(F.min("task_ord").alias("first_ord"))
    judged = lookup_join(tried, firsts, ["slug"])
    good_one, later = F.col("outcome").isNotNull(), F.col("task_ord") > F.col("first_ord")
    skipped = F.coalesce(later, F.lit(False)) & F.lit(not force)
    result = F.when(skipped, "skipped").when(good_one, "enriched").otherwise("failed")
    shown = good_one & ~skipped
    outcome = F.when(later, F.lit("updated")).otherwise(F.col("outcome"))
    done = judged.select("task_ord", result.alias("result"), F.when(shown, F.col("status")).alias("status"), F.when(shown, outcome).alias("outcome"))
    none = F.lit(None).cast("string")
    rest = slugged.select("task_ord").join(todo.select("task_ord"), "task_ord", "left_anti").select(
        "task_ord", F.lit("skipped").alias("result"), none.alias("status"), none.alias("outcome"))
    return done.unionByName(rest)
