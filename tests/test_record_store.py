import random

from entiform.functions.storage import children
from entiform.sources.record_store import RecordStore

SCHEMA = "slug string, v int"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(store, spark):
    return sorted(map(tuple, store.read(spark).collect()), key=str)


def test_equals_a_dict(spark, tmp_path):
    store, model, rng = RecordStore(f"{tmp_path}/s", SCHEMA, buckets=8), {}, random.Random(2)
    assert held(store, spark) == []
    for step in range(5):
        new = {f"k{rng.randrange(60)}": rng.randrange(1000) for _ in range(25)}
        got = dict(map(tuple, store.upsert(rows(spark, *new.items()), step).collect()))
        assert got == {k: "updated" if k in model else "created" for k in new}
        model.update(new)
        assert held(store, spark) == sorted(model.items())
        if step == 2:
            store.rebucket(spark, 16)
            assert held(store, spark) == sorted(model.items())
    before = held(store, spark)
    assert store.upsert(rows(spark, ("k1", -1)), 3).count() == 0 and held(store, spark) == before
    store.expire(spark)
    assert held(store, spark) == before and store.upsert(rows(spark, ("k1", -1)), 3).count() == 0
    assert sorted(r.slug for r in store.lookup(rows(spark, ("k1", 0), ("nobody", 0))).collect()) == ["k1"] * ("k1" in model)


def test_upsert_rewrites_its_buckets_only(spark, tmp_path):
    store = RecordStore(f"{tmp_path}/s", SCHEMA, buckets=32)
    store.upsert(rows(spark, *[(f"k{i}", i) for i in range(2000)]))
    store.upsert(rows(spark, ("k5", -5), ("k6", -6), ("new", 1)))
    assert len(store.touched) <= 3
    assert len([n for n in children(spark, f"{tmp_path}/s/data/version=2") if n.startswith("bucket=")]) == len(store.touched)
    got = dict(held(store, spark))
    assert len(got) == 2001 and got["k5"] == -5 and got["k6"] == -6 and got["k7"] == 7 and got["new"] == 1


def test_failed_upsert_counts_for_nothing(spark, tmp_path):
    store = RecordStore(f"{tmp_path}/s", SCHEMA, buckets=4)
    store.upsert(rows(spark, ("a", 1), ("b", 2)), 0)
    store._write(rows(spark, ("a", 9)), 4, 2)  # stopped before its commit
    assert held(store, spark) == [("a", 1), ("b", 2)]
    store.upsert(rows(spark, ("b", 3)), 1)
    assert held(store, spark) == [("a", 1), ("b", 3)]


def test_null_keys_and_empty_batches(spark, tmp_path):
    store = RecordStore(f"{tmp_path}/s", SCHEMA, buckets=4)
    assert store.upsert(rows(spark), 0).count() == 0 and held(store, spark) == []
    store.upsert(rows(spark, (None, 1), ("", 2)))
    store.upsert(rows(spark, (None, 3)))
    assert held(store, spark) == [("", 2), (None, 1), (None, 3)]


def test_stream(spark, tmp_path):
    store = RecordStore(f"{tmp_path}/s", SCHEMA, buckets=4)
    for i in range(3):
        rows(spark, (f"k{i}", i), ("same", i)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert {r.slug for r in store.read(spark).collect()} == {"k0", "k1", "k2", "same"} and store.read(spark).count() == 4
