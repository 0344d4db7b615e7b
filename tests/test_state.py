import random

from pyspark.sql import functions as F

from entiform.functions.storage import Scratch
from entiform.streaming.leads import LeadIntake, stream_leads
from entiform.streaming.state import KeyStore
from registry.views import view

SMALL = "/root/testdata/sf0.001"
SCHEMA = "signal int, key string, owner string"


def store(tmp_path, **kw):
    return KeyStore(str(tmp_path / "store"), SCHEMA, ("signal", "key"), **kw)


def batch(spark, scratch, name, keys):
    return scratch.write(spark.createDataFrame([(s, k, f"o{k}") for s, k in keys], SCHEMA).coalesce(1), name)


def asked(spark, scratch, name, keys):
    return scratch.write(spark.createDataFrame(list(keys), "signal int, key string").coalesce(1), name)


def test_fifty_batches_cost_what_they_ask(spark, tmp_path):
    """Every batch finds exactly what earlier ones stored, and what it reads does not grow with the stream."""
    rng, scratch = random.Random(1), Scratch(spark, "state")
    kept, known, read = store(tmp_path, fanout=4, bucket_rows=64), {}, []
    for n in range(50):
        fresh = {(rng.choice([1, 2]), f"k{n}-{i}") for i in range(40)}
        old = set(rng.sample(sorted(known), min(len(known), 5)))
        kept.merge(spark, n)
        got = kept.lookup(asked(spark, scratch, f"ask-{n}", fresh | old), n, scratch, f"look-{n}").collect()
        assert {(r["signal"], r["key"]): r["owner"] for r in got} == {k: known[k] for k in old} and len(got) == len(old)
        read.append(kept.last_lookup)
        kept.put(batch(spark, scratch, f"new-{n}", fresh), n)
        known.update({k: f"o{k[1]}" for k in fresh})
    assert kept.rows(spark).count() == len(known) == 2000
    assert max(r["segments"] for r in read) <= 3 * 3 + 1
    # 5 known keys and few false ones pass the filters, whatever is stored; a filter is asked at most once for each key and segment.
    assert max(r["maybe"] for r in read[10:]) <= 5 + 12 and sum(r["maybe"] - 5 for r in read[10:]) / 40 < 4
    assert all(r["row_files"] <= r["maybe"] for r in read)
    late, all_files = read[-1], read[-1]["buckets"]
    assert late["row_files"] < all_files / 2 and late["filter_files"] <= all_files


def test_only_asked_buckets_are_opened(spark, tmp_path):
    scratch, kept = Scratch(spark, "state"), store(tmp_path, bucket_rows=20)
    kept.put(batch(spark, scratch, "new", [(1, f"k{i}") for i in range(1000)]), 0)
    assert kept.segments(spark)[0].buckets == 64
    found = kept.lookup(asked(spark, scratch, "ask", [(1, "k7"), (1, "nothing"), (2, "k7")]), 1, scratch)
    assert [r["owner"] for r in found.collect()] == ["ok7"] and len(found.inputFiles()) <= 1 + kept.last_lookup["row_files"]
    assert kept.last_lookup["filter_files"] <= 3 and kept.last_lookup["row_files"] <= 3


def test_replays_and_broken_merges(spark, tmp_path):
    scratch, kept = Scratch(spark, "state"), store(tmp_path, fanout=2, bucket_rows=8)
    for n in range(5):
        kept.merge(spark, n)
        kept.put(batch(spark, scratch, f"new-{n}", [(1, f"{n}-{i}") for i in range(10)]), n)
    every = asked(spark, scratch, "ask", [(1, f"{n}-{i}") for n in range(6) for i in range(10)])
    for n in range(6):  # a replayed batch sees what was there before it, merged or not
        assert kept.lookup(every, n, scratch, f"at-{n}").count() == 10 * n
    kept.put(batch(spark, scratch, "again", [(1, f"1-{i}") for i in range(10)]), 1)  # merged already
    kept.put(batch(spark, scratch, "last", [(1, f"4-{i}") for i in range(10)]), 4)
    assert kept.rows(spark).count() == 50
    # A merge that ended before its filters were complete counts for nothing; one that did not clean up is cleaned up.
    parts = kept.segments(spark)
    whole = kept._segment(0, 4, 9, 50)
    kept._write(kept._read(spark, "rows", [(s, None) for s in parts]).drop("bucket", "segment"), whole)
    assert kept.segments(spark) == [whole] and kept.rows(spark).count() == 50
    (tmp_path / "store" / "filters" / f"segment={whole.name}" / "_SUCCESS").unlink()
    assert kept.segments(spark) == parts and kept.rows(spark).count() == 50
    kept._write(kept._read(spark, "rows", [(s, None) for s in parts]).drop("bucket", "segment"), whole)
    kept.merge(spark, 5)
    assert kept._all(spark) == [whole]


def test_empty_store_and_empty_batches(spark, tmp_path):
    scratch, kept = Scratch(spark, "state"), store(tmp_path)
    ask = asked(spark, scratch, "ask", [(1, "a")])
    assert kept.lookup(ask, 0, scratch).columns == ["signal", "key", "owner"] and kept.rows(spark).count() == 0
    kept.put(batch(spark, scratch, "none", [(1, "a")]).limit(0), 0)
    assert kept.segments(spark) == []
    kept.put(batch(spark, scratch, "one", [(1, "a")]), 1)
    assert kept.lookup(ask.limit(0), 2, scratch, "no").count() == 0 and kept.lookup(ask, 1, scratch, "early").count() == 0
    assert kept.lookup(ask, 2, scratch, "late").count() == 1


def test_intake_over_merged_segments(spark, tmp_path):
    """Many small batches give the decisions of one, and a replay after merges changes nothing."""
    places = view(spark, SMALL, "places_v")
    whole, parts = LeadIntake(str(tmp_path / "whole")), LeadIntake(str(tmp_path / "parts"), fanout=2, bucket_rows=16)
    whole(stream_leads(places), 0)
    steps = [stream_leads(places.filter(F.col("ord").between(25 * n, 25 * n + 24))) for n in range(7)]
    for n, step in enumerate(steps):
        parts(step, n)
    assert max(s.level for s in parts.owners.segments(spark)) >= 2
    names = ("ord", "id", "duplicate", "reason", "matched_id")
    want = sorted(map(str, whole.read(spark, "decisions").select(*names).collect()))
    assert sorted(map(str, parts.read(spark, "decisions").select(*names).collect())) == want
    parts(steps[1], 1)
    parts(steps[6], 6)
    assert sorted(map(str, parts.read(spark, "decisions").select(*names).collect())) == want
