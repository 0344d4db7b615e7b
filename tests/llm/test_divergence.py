import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from check import rows_of
from entiform.llm import divergence as D
from entiform.llm.queries import OP13_SQL, op13_divergence

FOLDER = "/root/testdata/sf0.001"


def brute(rows, min_docs, top):
    counts, on, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(terms)
        on[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in on[lang].items() if k >= min_docs)

        def shares(seen):
            total = sum(seen[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (seen[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(sum((counts[lang, s] for s in sources), Counter()))
        for a in sources:
            parts = {"pair": [(-sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in kept), b.encode()) for b in sources if a != b],
                     "term": [(-((p[a][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, a][t] and p[a][t] > q[t]]}
            for part, found in parts.items():
                ranked = sorted(found)
                out += [(lang, a, part, item.decode(), -v, k) for k, (v, item) in enumerate(ranked if part == "pair" else ranked[:top], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("seed, part_rows, held, peers", [(1, 300_000, 300_000, 4096), (2, 15, 20, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, part_rows, held, peers):
    for name, value in (("PART_ROWS", part_rows), ("HELD_TERMS", held), ("PEERS", peers)):
        monkeypatch.setattr(D, name, value)
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["The", "THE", "Été", "été", "É", "中文", "İ", "\U0001f600", "a1b", "x\u0080y", "_"]
    rows = [(rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 40)))]), rng.choice(["en", "en", "en", "fr", None, ""]), rng.choice(["s0", "s0", "s1", "s2", "é", "\U0001f600", None])) for _ in range(200)]
    rows += [("lone " * 4, "xx", "a"), ("other", "xx", "b"), (None, "xx", None), ("one two " * 30_000, "fr", "s9"), ("one two", "fr", "s0"), ("one two", "fr", "s1")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS p", "4 AS Part").repartition(3)
    got = D.audit(docs, 3, 20)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 3, 20)
    assert D.audit(docs.limit(0)).count() == 0


def test_large_counts(spark):
    big = 4_000_000_000_000_000_000
    got = spark.createDataFrame([(big, big), (0, big), (7, 9)], "n long, total long").select(D.share_of(D.F.col("n"), D.F.col("total"), D.F.lit(5).cast("long")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (n + 1) // (t + 5) for n, t in [(big, big), (0, big), (7, 9)]]


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cur = con.execute(OP13_SQL)
    names = [c[0] for c in cur.description]
    df = op13_divergence(spark, FOLDER)
    got = df.collect()
    assert rows_of(df.columns, [tuple(r) for r in got]) == rows_of(names, cur.fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text", "lang", "source").collect()]
    assert sorted(str(tuple(r)) for r in got) == brute(rows, 3, 200)
