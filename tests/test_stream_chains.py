import random

from pyspark.sql import functions as F

from entiform.operators.chains import detect_chains
from entiform.operators.leads import normalize_leads
from entiform.streaming.chains import ChainIntake


def leads_of(spark, rows):
    return normalize_leads(spark.createDataFrame(rows, "ord bigint, source string, company_name string, city string"))


def chained(df):
    return sorted(tuple(r) for r in df.select("ord", F.coalesce("chain.name", F.lit(""))).collect())


def test_stream_equals_batch_after_every_prefix(spark, tmp_path):
    rng = random.Random(3)
    names, cities = ["Azur Lodge", "Bel Air Inn", "Onomo Douala", "Cascade", "Delta Palace", "", "Zenith Club"], ["Douala", "Kribi", "Yaoundé", None]
    rows = [(k, "t", rng.choice(names), rng.choice(cities)) for k in range(40)] + [(100, "t", "Late Star", "Douala"), (101, "t", "Late Star", "Douala")]
    last = [(102, "t", "LATE STAR", "Kribi"), (-1, "t", "late star", "Douala")]
    parts = [rows[:10], rows[10:12], [], rows[12:], last]
    intake, seen, before = ChainIntake(f"{tmp_path}/c", buckets=4), [], set()
    for n, part in enumerate(parts):
        batch = leads_of(spark, part)
        intake(batch, n)
        intake(batch, n)  # replayed
        seen += part
        assert chained(intake.read(spark)) == chained(detect_chains(leads_of(spark, seen)))
        # what changed for earlier leads is what the table of changes says
        now = {r[0]: r[1] for r in chained(intake.read(spark))}
        moved = {o for o, label in before if now[o] != label}
        told = {r["brand"] for r in intake.changes(spark).where(F.col("batch_id") == n).collect()}
        assert bool(moved) <= bool(told)
        before = set(now.items())
    assert {r["label"] for r in intake.changes(spark).where("batch_id = 4").collect()} == {"late star"}
