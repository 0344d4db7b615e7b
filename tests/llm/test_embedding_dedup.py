import math
import os

import numpy as np
import pytest

from entiform.functions.storage import work_dir
from entiform.llm import embedding_dedup as E


def case():
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for size in (1, 1, 2, 3, 60) * 8:
        base = rng.normal(size=16)
        for _ in range(size):
            rows.append((at, (base + rng.normal(scale=rng.choice([0, 0.02, 0.08]), size=16)).astype("f4").tolist()))
            at += 1
    return rows


@pytest.mark.parametrize("block", [4_096, 20])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "_CHUNK", 16 if block == 20 else 512)
    rows = case()
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [math.nan] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [math.inf] * 16), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [5.0])]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    label = np.arange(len(x))
    for _ in range(20):
        label = np.where(near, label[None, :], len(x)).min(1)
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS key", "2 AS cell")
    got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in E.near_classes(df, per_cell=4).collect()}
    want = {i: (int(label[i]), int(near[i].sum()) - 1) for i, _ in rows}
    found = sum(n for i, (_, n) in got.items() if i < 9000)
    assert found >= 0.98 * sum(n for _, n in want.values()) and all(n <= want[i][1] for i, (_, n) in got.items() if i < 9000)
    assert sum(got[i][0] == want[i][0] for i in want) >= 0.99 * len(want)
    assert {i: got[i] for i, _ in odd} == {i: (9006, 1) if i in (9006, 9007) else (i, 0) for i, _ in odd}


def test_copies_and_odd_ids(spark):
    rows = [(5, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [2.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (7, [0.0, 1.0])]
    out = E.near_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(str((r["vec_id"], r["class_id"], r["n_links"])) for r in out.collect()) == sorted(map(str, [(5, 4, 3), (4, 4, 3), (4, 4, 3), (None, 4, 3), (None, 7, 1), (7, 7, 1)]))
    assert E.near_classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    index = E.MultiIndex({8: (rng.normal(size=(5, 4)), rng.normal(size=(6, 4)))})
    x = rng.normal(size=(20, 8))
    a, b = index._distances(x)
    total = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    assert (index.order(x, 7) == np.argsort(total, 1)[:, :7]).all() and (index.order(x, 99) == np.argsort(total, 1)).all()


def test_few_planted_pairs(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=(200, 64))
    side -= (side * x[:200]).sum(1)[:, None] * x[:200]
    side /= np.linalg.norm(side, axis=1)[:, None]
    x = np.vstack([x, 0.951 * x[:200] + math.sqrt(1 - 0.951 ** 2) * side])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = E.near_classes(df).where("n_links > 0").collect()
    assert sum(r["vec_id"] >= 20_000 and r["class_id"] == r["vec_id"] - 20_000 for r in out) >= 196


def test_disk_follows_the_table_and_not_the_visits(spark, monkeypatch):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(6_000, 64)).astype("f4")
    x[3_000:3_400] = x[:400] + rng.normal(scale=0.05, size=(400, 64)).astype("f4")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    folder = work_dir(spark)

    def stored():
        return {os.path.join(at, n): os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(folder) for n in names}

    def run():
        before = set(stored())
        got = sorted(E.near_classes(df).collect())
        return got, {k: v for k, v in stored().items() if k not in before}

    whole, _ = run()
    monkeypatch.setattr(E, "ROUND_BYTES", 1 << 18, raising=False)
    monkeypatch.setattr(E, "BLOCK", 512)
    parted, files = run()
    assert parted == whole and sum(r["n_links"] for r in whole) >= 790
    assert len({os.path.dirname(f) for f in files if "links-" in f}) >= 3
    assert sum(files.values()) < 2 * x.nbytes


def test_hot_cell_is_cut_into_blocks():
    parts = E.Parts.of([(8, 0, 5), (8, 1, 30), (8, 2, 4), (8, 5, 3), (8, 6, 2)], {8: 12}, {8: 4}, 10)
    assert parts.first[8][[0, 1, 2, 5, 6]].tolist() == [0, 1, 4, 4, 4] and parts.blocks[8][[0, 1, 2, 3, 5]].tolist() == [1, 3, 1, 0, 1] and parts.count == 5
    route, hashes = np.array([[1, 0], [2, 3], [5, 1]], np.uint16), np.array([4, 7, 9])
    row, part, cell, home = parts.visits(8, route, hashes)
    assert sorted(zip(row.tolist(), part.tolist(), cell.tolist(), home.tolist())) == sorted([
        (0, 1, 1, False), (0, 2, 1, True), (0, 3, 1, False), (0, 0, 0, False), (1, 4, 2, True), (2, 4, 5, True), (2, 1, 1, False), (2, 2, 1, False), (2, 3, 1, False)])
    some = parts.visits(8, route, hashes, np.array([False, False, True, False, True]))
    assert sorted(zip(*(x.tolist() for x in some))) == [(0, 2, 1, True), (1, 4, 2, True), (2, 2, 1, False), (2, 4, 5, True)]
