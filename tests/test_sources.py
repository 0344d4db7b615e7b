import glob
import json

import pytest
from pyspark.sql import functions as F

from entiform import schemas
from entiform.operators.leads import normalize_leads
from entiform.plans import lead_run, record_run, stages
from entiform.sources import readers, writers


def leads(spark, *names):
    df = spark.createDataFrame([(i, "google-maps", n, "Douala") for i, n in enumerate(names)], "ord bigint, source string, company_name string, city string")
    contact = f"array<{schemas.CONTACT}>"
    first = F.array(F.struct(*[F.lit({"full_name": "Jean Kamga", "title_raw": "Directeur Général"}.get(n)).cast("string").alias(n) if n != "confidence"
                               else F.lit(None).cast("double").alias(n) for n in ("full_name", "role", "title_raw", "email_direct", "phone_direct", "linkedin_url", "confidence")]))
    return normalize_leads(df.withColumn("contacts", F.when(F.col("ord") == 0, first.cast(contact))))


def test_format():
    assert [writers.resolve_format(*a) for a in (("a/b.csv",), ("a/b.json",), ("a/b.xlsx",), ("a/b.txt", "json"), ("a/b",), ("a.CSV", "odd"))] == [
        "csv", "json", "excel", "json", "excel", "csv"]


def test_exports(spark, tmp_path):
    df = leads(spark, "Hôtel Akwa Palace", 'La "Falaise"; x').coalesce(1)
    assert writers.write_entities(df, str(tmp_path / "o.json")) == "json"
    assert spark.read.json(str(tmp_path / "o.json")).count() == 2
    writers.write_entities(df, str(tmp_path / "o.csv"))
    for part in glob.glob(str(tmp_path / "o.csv" / "part*")):
        raw = open(part, encoding="utf-8").read()
        assert raw.startswith("﻿Establishment name;Legal name;")
        assert len(raw.strip().split("\n")) == 3 and "Hôtel Akwa Palace;" in raw and '"La ""Falaise""; x";' in raw
    writers.write_entities(df, str(tmp_path / "o.xlsx"))
    assert spark.read.parquet(str(tmp_path / "o.xlsx/establishments")).count() == 2
    assert spark.read.parquet(str(tmp_path / "o.xlsx/contacts")).count() == 1


def test_progress(spark, tmp_path):
    path = writers.progress_path(str(tmp_path), "./out/leads.xlsx", writers.run_signature("a", "b"))
    assert "out-leads-xlsx/signature=" in path and path != writers.progress_path(str(tmp_path), "./out/leads.xlsx", writers.run_signature("a", "c"))
    assert writers.load_progress(spark, path) is None
    df = leads(spark, "A", "B")
    writers.append_progress(df, path, 1)
    writers.append_progress(df.filter("ord = 0").withColumn("enrich_attempted", F.lit(True)), path, 2)
    writers.append_progress(df.filter("ord = 0").withColumn("enrich_attempted", F.lit(True)), path, 2)
    assert {r.ord: r.enrich_attempted for r in writers.load_progress(spark, path).collect()} == {0: True, 1: None}
    writers.clear_progress(spark, path)
    assert writers.load_progress(spark, path) is None


def test_progress_log(spark, tmp_path):
    lines = [{"id": "a", "source": "s", "company_name": "Old", "seq": 1}, {"id": "a", "source": "s", "company_name": "New", "seq": 2},
             {"id": "b", "source": "s", "company_name": "B", "seq": 3}, {"id": "c", "source": "s", "company_name": "", "seq": 4}]
    lines = [{"emails": [], "phones": [], "contacts": [], "enriched_by": [], **x} for x in lines]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + '\n{"id":"broken","compan')
    good, skipped = readers.read_progress_log(spark, str(tmp_path / "log.jsonl"))
    assert {r.id: r.company_name for r in good.collect()} == {"a": "New", "b": "B"}
    assert skipped.count() == 2


def test_task_lists(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"Douala": {"country": "Cameroun", "hotels": [" A ", "B"]}, "Kribi": {"country": "Cameroun", "hotels": ["C"]}}))
    rows = readers.read_task_lists(spark, str(tmp_path / "t.json")).orderBy("task_ord").collect()
    assert [(r.input_name, r.city, r.country) for r in rows] == [("A", "Douala", "Cameroun"), ("B", "Douala", "Cameroun"), ("C", "Kribi", "Cameroun")]
    (tmp_path / "bad.json").write_text(json.dumps({"Douala": {"country": "", "hotels": ["A"]}}))
    with pytest.raises(Exception, match="empty country or name"):
        readers.read_task_lists(spark, str(tmp_path / "bad.json")).collect()


def test_records_file(spark, tmp_path):
    base = {"input_name": "n", "name": "n", "city": "c", "country": "k", "governance_confidence": 0.5, "sources": [], "status": "auto", "model": "m",
            "enriched_at": "2026-01-01T00:00:00Z"}
    items = [{**base, "slug": "a", "name": "old"}, {**base, "slug": "a", "name": "new"}, {**base, "slug": "b", "status": "odd"}, {"slug": "c"}]
    (tmp_path / "r.json").write_text(json.dumps(items))
    (tmp_path / "broken.json").write_text("{not json")
    assert [(r.slug, r.name) for r in readers.read_records(spark, str(tmp_path)).collect()] == [("a", "new")]


def test_stage_list():
    assert stages.parse_stages("all") == ["website", "email", "reviews"]
    assert stages.parse_stages(" reviews, Website,odd") == ["website", "reviews"] and stages.parse_stages(None) == []


def test_whole_run_with_resume(spark):
    places = spark.createDataFrame([
        (0, "s", "Hôtel A", "https://www.google.com/maps/place/a/@4.05,9.76,17z", "Bonapriso, Douala, Cameroun", "699000000", "a.cm"),
        (1, "s", "Hôtel B", "https://www.google.com/maps/place/b/@4.05,9.76,17z", "Yaoundé, Cameroun", "699000001", "b.cm"),
        (2, "s", "HOTEL A", None, "Douala", None, None)],
        "ord bigint, search_id string, name string, place_url string, address string, phone string, website string").withColumns(
        {c: F.lit(None).cast("string") for c in ("category", "rating_text", "reviews_text")})
    accepted = lead_run.collect_leads(places)
    assert accepted.count() == 2
    tables = {
        "pages": spark.createDataFrame([(1, "https://a.cm", "<body>info@a.cm</body>")], "page_id bigint, url string, html string"),
        "domain_facts": spark.createDataFrame([("a.cm", True, False)], "domain string, has_mx boolean, catch_all boolean"),
        "address_facts": spark.createDataFrame([("info@a.cm", True)], "email string, accepted boolean"),
        "reviews": spark.createDataFrame([], "lead_id string, pos int, author string, rating_label string, text string")}
    restored = accepted.filter("ord = 1").withColumn("enrich_attempted", F.lit(True))
    out = {r.ord: r for r in lead_run.finish_leads(accepted, stages.make_stages("all"), tables, restored).collect()}
    assert out[0].email == "info@a.cm" and out[0].email_status == "valid" and out[0].enriched_by == ["website", "email"]
    assert out[1].enriched_by == [] and out[1].enrich_attempted and not out[0].chain.is_chain


def test_record_run(spark):
    tasks = spark.createDataFrame([(1, "Hôtel Akwa", "Douala", "Cameroun"), (2, "HOTEL AKWA", "Douala", "Cameroun"), (3, "Lac", "Kribi", "Cameroun"), (4, "Rive", "Kribi", "Cameroun")],
                                  "task_ord bigint, input_name string, city string, country string")
    found = spark.createDataFrame([(1, '{"owner": "X", "governance_confidence": 0.9}', ["https://x.cm"]), (2, '{"owner": "Y"}', []), (3, "none", []), (4, "{}", [])],
                                  "task_ord bigint, answer string, sources array<string>")
    stored = spark.createDataFrame([], schemas.RECORD)
    new = record_run.research_records(tasks, found, stored, "m")
    rows = {r.slug: r for r in new.collect()}
    assert rows["douala-akwa"].owner == "X" and rows["douala-akwa"].status == "auto" and set(rows) == {"douala-akwa", "kribi-rive"}
    after = record_run.store_records(stored, new)
    assert {r.outcome for r in after.collect()} == {"created"}
    summary = record_run.run_summary(record_run.task_outcomes(tasks, found, stored, "m")).first()
    assert tuple(summary) == (4, 2, 1, 1, 1, 2, 0)
    forced = record_run.research_records(tasks, found, after.drop("outcome"), "m", force=True)
    assert {r.slug: r.owner for r in forced.collect()}["douala-akwa"] == "Y"
