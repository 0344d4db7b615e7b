"""Pages of a site meet in tasks whose number follows the rows and the length of their html."""

from pyspark.sql import functions as F

from entiform.functions import storage
from entiform.operators import extract, ordering
from entiform.operators.leads import normalize_leads
from entiform.operators.lookups import lookup_join
from registry.views import view


def sites(spark, n):
    rows = spark.range(2 * n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://s"), F.floor(F.col("id") / 2).cast("string"), F.lit(".cm")).alias("root"))
    contact = F.col("page_id") % 2 == 1
    return rows.select(
        "page_id", F.when(contact, F.concat("root", F.lit("/contact"))).otherwise(F.col("root")).alias("url"),
        F.when(contact, F.concat(F.lit("<p>info@"), F.substr("root", F.lit(9)), F.lit("</p>"))).otherwise(F.lit("<p>home</p>")).alias("html"))


def test_tasks_follow_rows_and_html(spark, monkeypatch):
    pages = sites(spark, 300)
    monkeypatch.setattr(storage, "ROWS_MET", 10)
    facts = extract.site_facts(pages)
    assert facts.rdd.getNumPartitions() == 60 and extract.site_pages(pages).rdd.getNumPartitions() == 60
    found = {r.site: r.emails for r in facts.collect()}
    assert found == {f"s{i}.cm": [f"info@s{i}.cm"] for i in range(300)}
    raw = spark.range(600).select(
        F.col("id").alias("ord"), F.lit("s").alias("source"), F.lit("X").alias("company_name"),
        F.when(F.col("id") > 0, F.concat(F.lit("http://s"), (F.col("id") % 400).cast("string"), F.lit(".cm"))).alias("website_url"))
    patch = extract.enrich_from_pages(normalize_leads(raw), pages)
    assert patch.rdd.getNumPartitions() == 60
    want = {i: [f"info@s{i % 400}.cm"] if i % 400 < 300 else [] for i in range(1, 600)}
    assert {r.ord: r.emails for r in patch.select("ord", "emails").collect()} == want
    monkeypatch.setattr(storage, "ROWS_MET", 60_000)
    monkeypatch.setattr(storage, "BYTES_PER_TASK", 100)
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0]
    assert extract.site_facts(pages).rdd.getNumPartitions() == -(-size // 100) > 60
    # pages off the contact paths and failed visits have no weight
    off = pages.select("page_id", F.lit("https://s.cm/rooms").alias("url"), "html").unionByName(pages.withColumn("html", F.lit(None).cast("string")).limit(1))
    assert extract.site_facts(off).rdd.getNumPartitions() == 1


def test_stored_pages_are_files_of_few_rows(spark, tmp_path, monkeypatch):
    spark.range(600).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 10)
    pages = view(spark, str(tmp_path), "site_pages_v")
    per_file = pages.groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in per_file) == 2_400 and max(r["count"] for r in per_file) <= 20


def test_visits_of_one_path_are_cut_in_spread_parts(spark):
    rows = [("a", 0, True, f"u{i % 7}", i) for i in range(400, 0, -1)] + [("a", 0, False, "t", 0)] + [("a", 1, True, None, None)] * 50 + [
        ("a", 2, False, "u", 1), ("a", 3, True, "u", 1), (None, 0, True, "u", 1), (None, 0, True, "u", 2), ("b", 0, False, "u", 1), ("b", 1, True, "u", 1), ("a", None, True, "u", 1)]
    df = spark.createDataFrame(rows, "site string, path_rank int, ok boolean, url string, page_id bigint").repartition(5)
    for parts in (None, 1, 7):
        got = ordering.page_budget(df, parts=parts)
        assert sorted((r.site or "", r.path_rank, r.url, r.page_id) for r in got.collect()) == [
            ("", 0, "u", 1), ("a", 0, "u0", 7), ("a", 1, None, None), ("a", 3, "u", 1)]
        assert got.columns == df.columns
    assert ordering.page_budget(df, max_pages=1, parts=3).count() == 2
    assert "_salt" in ordering.page_budget(df, parts=3)._jdf.queryExecution().optimizedPlan().toString()


def test_lookup_meets_in_given_parts(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(100)], "i int, k int")
    facts = spark.createDataFrame([(k, k * 10) for k in range(6)] + [(None, 1), (3, 31)], "k int, v int")
    plain = lookup_join(rows, facts, ["k"]).collect()
    assert sorted(plain, key=str) == sorted(lookup_join(rows, facts, ["k"], parts=13).collect(), key=str)
    assert len(plain) == 100 + sum(1 for r in rows.collect() if r.k == 3)
