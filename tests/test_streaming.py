from pyspark.sql import functions as F

from entiform.operators.dedup import dedup_decisions
from entiform.plans.lead_run import places_to_leads
from entiform.streaming.leads import LeadIntake, incremental_enrichment, stream_leads
from registry.views import view

SMALL = "/root/testdata/sf0.001"


def feed(spark, tmp_path, parts):
    places = view(spark, SMALL, "places_v")
    for i, (lo, hi) in enumerate(parts):
        places.filter(F.col("ord").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return places, spark.readStream.schema(places.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    places, source = feed(spark, tmp_path, [(0, 49), (50, 99)])
    intake = LeadIntake(str(tmp_path / "out"))
    intake.start(stream_leads(source)).awaitTermination()
    places.filter("ord > 99").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    intake.start(stream_leads(source)).awaitTermination()
    want = sorted(tuple(r) for r in dedup_decisions(places_to_leads(places)[0]).collect())
    got = sorted(tuple(r) for r in intake.read(spark, "decisions").select("ord", "id", "duplicate", "reason", "matched_id").collect())
    assert got == want
    stats = intake.stats(spark).first()
    assert (stats.received, stats.invalid, stats.accepted) == (150, 0, sum(not w[2] for w in want))
    assert intake.read(spark, "leads").count() == stats.accepted


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    places = view(spark, SMALL, "places_v")
    intake = LeadIntake(str(tmp_path / "out"))
    batches = [stream_leads(places.filter("ord < 60")), stream_leads(places.filter("ord >= 60"))]
    for i in (0, 1):
        intake(batches[i], i)
    first = sorted(map(str, intake.read(spark, "decisions").collect()))
    intake(batches[1], 1)
    assert sorted(map(str, intake.read(spark, "decisions").collect())) == first


def test_what_arrived_first_wins_whatever_its_order(spark, tmp_path):
    places = view(spark, SMALL, "places_v").filter("ord = 0")

    def listing(ord, name, phone):
        return stream_leads(places.withColumns({"ord": F.lit(ord).cast("bigint"), "name": F.lit(name), "phone": F.lit(phone), "website": F.lit(None).cast("string")}))

    intake = LeadIntake(str(tmp_path / "out"))
    for k, row in enumerate([(10, "Alpha", "699 11 22 33"), (5, "Beta", "699 11 22 33"), (7, "Beta", None), (6, "Alpha", None)]):
        intake(listing(*row), k)
    got = {r.ord: (r.duplicate, r.reason) for r in intake.read(spark, "decisions").collect()}
    assert got == {10: (False, None), 5: (True, "phone"), 7: (False, None), 6: (True, "name+city")}
    assert sorted(r.ord for r in intake.read(spark, "leads").collect()) == [7, 10]


def test_incremental_enrichment(spark, tmp_path):
    class Mark:
        name = "mark"

        def eligible(self, leads):
            return leads

        def patch(self, leads, tables):
            return leads.select("ord", F.lit("x").alias("legal_name"))

    leads = places_to_leads(view(spark, SMALL, "places_v"))[0]
    write = incremental_enrichment(str(tmp_path), [Mark()], {})
    write(leads.filter("ord < 10"), 0)
    write(leads.filter("ord < 15"), 1)
    stored = spark.read.parquet(str(tmp_path / "enriched"))
    assert stored.count() == 15 and stored.filter("legal_name = 'x' AND enrich_attempted").count() == 15
