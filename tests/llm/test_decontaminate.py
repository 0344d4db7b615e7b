import random
import re

import pytest

from entiform.llm import decontaminate as D


def shingles(text):
    """Of an item."""
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def runs(text):
    """Of a document: runs of one to five words."""
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i:i + n]) for n in range(1, 6) for i in range(len(w) - n + 1)}


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(6)
    word = [f"w{k}" for k in range(80)]
    items = [(k, " ".join(rng.choice(word) for _ in range(rng.choice((2, 4, 5, 6, 9, 30, 60))))) for k in range(40)] + [(100, None), (101, ""), (102, "..."), (None, "alone item of seven words in all"), (3, "one more text of item three")]
    docs = []
    for k in range(150):
        parts = [" ".join(rng.choice(word) for _ in range(rng.randrange(80)))]
        for _ in range(rng.randrange(3)):
            cut = (rng.choice(items)[1] or "").split()
            if cut and rng.random() < 0.6:
                cut[rng.randrange(len(cut))] = "changed"
            parts.append(" ".join(cut))
        docs.append((k % 140, "\n".join(parts).title()))
    docs += [(900, None), (901, ""), (None, "Alone item, of seven words in all!"), (902, items[0][1]), (903, ("x y z " * 40_000) + items[5][1])]
    return docs, items


def test_equals_brute_force(spark, case):
    docs, items = case
    held, wanted = {}, {}
    for i, t in docs:
        held.setdefault(i, set()).update(runs(t))
    for i, t in items:
        wanted.setdefault(i, set()).update(shingles(t))
    want = {(d, i, len(s & q), len(q)) for d, s in held.items() for i, q in wanted.items() if q and len(s & q) >= 0.8 * len(q)}
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS item", "3 AS n", "4 AS item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS sh")
    out = D.contained(df, bench)
    assert {tuple(r)[:4] for r in out.collect()} == want and len(want) > 30
    clean = [i for i, t in docs if not any(q and len(runs(t) & q) >= 0.8 * len(q) for q in wanted.values())]
    got = D.clean(df, bench)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(map(str, clean)) and got.columns == df.columns and 0 < len(clean) < len(docs)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert D.contained(df.limit(0), bench).count() == 0 and D.contained(df, bench.limit(0)).count() == 0


def test_rows_are_judged_by_their_own_text(spark):
    """Rows that share an id, or have none, do not answer for each other; short items are found in long texts."""
    item = "seven words make up this benchmark item"
    rows = [(None, f"before {item} after"), (None, "a clean text without an id"), (None, None), (1, item), (1, "another clean text of the same id"), (2, "the answer is forty two as they say here"), (3, "forty and two"), (1, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS a", "2 AS __key")
    bench = spark.createDataFrame([(1, item), (2, "Forty, two!")], "item_id long, text string")
    got = D.clean(docs, bench)
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got.collect()])) == sorted(map(str, [rows[k] for k in (1, 2, 4, 6)])) and got.columns == docs.columns
    assert {(r["doc_id"], r["item_id"]) for r in D.contained(docs, bench).collect()} == {(None, 1), (1, 1), (2, 2)}


def test_same_without_broadcast(spark, case, monkeypatch):
    docs, items = case
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, D.contained(df, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert sorted(map(str, D.contained(df, bench).collect())) == want
