"""Pairs of names are spread over tasks of their own number."""

from pyspark.sql import functions as F

from entiform.operators import similarity


def test_pairs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS_PER_SALT", 3)
    rows = spark.range(40).select(F.col("id").alias("task_ord"), F.concat(F.lit("Falaise Bonapriso "), (F.col("id") + 100).cast("string")).alias("input_name"), F.lit("Douala").alias("city"))
    got = similarity.fuzzy_name_pairs(rows)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("levenshtein") > text.index("Aggregate")  # tree: the aggregate stands above the distance
    assert text.count("RepartitionByExpression") >= 4
    assert got.count() == got.select("form_a", "form_b").distinct().count() == 40 * 39 // 2
