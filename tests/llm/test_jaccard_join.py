import random

import numpy as np
import pytest

from entiform.llm import jaccard_join as J
from entiform.llm.common import words


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def links(rows):
    sets = [shingles(t) for _, t in rows]
    out = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                out.append((b, a))
    return out


def case():
    rng = random.Random(12)
    word = [f"w{k}" for k in range(500)]
    rows, at = [], 0
    for _ in range(25):
        base = [rng.choice(word) for _ in range(rng.choice((3, 5, 40, 120)))]
        for _ in range(rng.choice((1, 1, 2, 4, 25))):
            text = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                text[rng.randrange(len(text))] = rng.choice(word)
            rows.append((at, " ".join(text)))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket", [2_000, 12])
def test_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(J, "BUCKET", bucket)
    rows = case() + [(9000, None), (9001, ""), (9002, "?!")]
    found, up, count = links(rows), {i: i for i, _ in rows}, {i: 0 for i, _ in rows}
    for a, b in found:
        x, y = rows[a][0], rows[b][0]
        count[x], count[y] = count[x] + 1, count[y] + 1
        p, q = sorted((up[x], up[y]))
        up = {k: p if v == q else v for k, v in up.items()}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999).collect()}
    assert len(found) > 300
    assert got == {i: (up[i], count[i]) for i, _ in rows}


def test_keep_one(spark):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(3, near), (1, near + " more"), (3, near), (1, near + " more"), (1, "a text of its own with id one"), (None, near), (None, "alone with a null id, some words"), (None, "alone with a null id, some words"),
            (8, None), (8, ""), (8, "other words altogether in here"), (None, None), (9, "Other WORDS, altogether in here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS paths", "3 AS class_id", "4 AS n_links")
    out = J.keep_one(df)
    assert out.columns == df.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == sorted(str(x) for x in [
        (1, near + " more"), (1, "a text of its own with id one"), (None, "alone with a null id, some words"), (8, None), (8, ""), (8, "other words altogether in here"), (None, None)])
    assert J.keep_one(df.limit(0)).count() == 0
    assert J.near_classes(df.where("text IS NULL")).count() == 2


def test_very_long_texts(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in J.near_classes(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_default_recall_in_the_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(J, "BUCKET", 12)
    rng = random.Random(3)
    rows = []
    for k in range(1_500):  # pairs of 127 shingles, 113 of them shared, or 0.801; all share a passage of 26
        passage, own = [f"p{x}" for x in range(30)], [f"a{k}x{x}" for x in range(101)]
        rows.append((2 * k, " ".join(passage + own)))
        rows.append((2 * k + 1, " ".join(passage + own[:87] + [f"b{k}x{x}" for x in range(14)])))
    rng.shuffle(rows)
    sets = {i: shingles(t) for i, t in rows[:200]}
    assert all(0.8 <= len(s & shingles(t)) / len(s | shingles(t)) < 0.81 for i, s in sets.items() for j, t in rows if j == i ^ 1)
    got = {r["doc_id"]: r["class_id"] for r in J.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] != got[2 * k] for k in range(1_500)) <= 6


def test_runs_follow_from_the_levels():
    for levels in (1, 2, 3, 5):
        runs = J.runs_needed(0.8, 0.999, levels)
        assert J.lost(0.8, runs, levels) <= 0.001 < J.lost(0.8, runs - 1, levels)
    rng, n, few, enough = np.random.default_rng(1), 2_000, 0, 0
    starts = J._mix(np.arange(1, 1 + J.runs_needed(0.8, 0.999, 5), dtype=np.uint64))
    for _ in range(n):  # the tree itself, five levels deep
        same, value = rng.random(J.COORDINATES) < 0.8, rng.integers(0, 256, J.COORDINATES)
        found = [reaches(p, same, value, 5) for p in starts]
        few, enough = few + (not any(found[:7])), enough + (not any(found))
    assert few > 0.002 * n and enough <= 0.001 * n


def reaches(path, same, value, levels):
    return levels == 0 or any(same[c] and reaches(J.child(path, c, value[c:c + 1])[0], same, value, levels - 1) for c in J.chosen(int(path), 0.8))
