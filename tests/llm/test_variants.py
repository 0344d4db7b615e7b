import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from entiform.llm import variants as V
from entiform.llm.queries import op12_variants

FOLDER = "/root/testdata/sf0.001"


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def words_of(rows, least, count):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: k for w, k in n.items() if k >= count and len(w) >= least}


def grouped(n, times):
    near, known = {w: [] for w in n}, {}
    for w in n:  # both are looked up by what is left after one letter goes
        for cut in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            known.setdefault(cut, set()).add(w)
    for some in known.values():
        for a in some:
            near[a] += [b for b in some if a != b and is_near(a, b) and b not in near[a]]
    form = {}
    for w in n:
        best = min(((-n[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(map(str, out))


def test_search_equals_all_pairs():
    for seed in range(40):
        rng = random.Random(seed)
        letters = ["ab", "abcé", "abcdefgh", "aé中\U0001f600"][seed % 4]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(2, 10))) for _ in range(rng.randrange(1, 250))})
        n = np.array([rng.randrange(1, 6) for _ in words])
        held = np.array([seed % 3 > 0 or rng.random() < 0.7 for _ in words])
        sides = [V.search_block(words, n, held, side) for side in (1, 0)]
        for k, w in enumerate(words):
            want = sorted((-n[j], v) for j, v in enumerate(words) if held[j] and v != w and is_near(w, v))
            found = sorted((-s[2][k], words[s[1][k]]) for s in sides if s[1][k] >= 0)
            assert sum(s[0][k] for s in sides) == len(want) and found[:1] == want[:1]


def test_index_ranks():
    rng = np.random.default_rng(1)
    letters = rng.integers(0, 13, 400)
    ranks = V.Ranks(letters, 4)
    low = rng.integers(0, 401, 300)
    high = np.maximum(low, rng.integers(0, 401, 300))
    c = rng.integers(0, 13, 300)
    got = ranks.of(low, high, c)
    for k in range(300):
        part = letters[low[k]:high[k]]
        assert [int(x[k]) for x in got] == [(letters[:low[k]] == c[k]).sum(), (part == c[k]).sum(), (part < c[k]).sum()]
    owner, letter, rank, number, smaller = ranks.each(low, high)
    assert sorted(zip(owner.tolist(), letter.tolist())) == sorted({(k, int(x)) for k in range(300) for x in letters[low[k]:high[k]]})
    assert all((letters[low[o]:high[o]] == x).sum() == m and (letters[low[o]:high[o]] < x).sum() == s for o, x, m, s in zip(owner, letter, number, smaller))


@pytest.mark.parametrize("block", [20_000, 6])
def test_groups_equal_brute_force(spark, block):
    rng = random.Random(block)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(6, 9))): rng.choice([5, 6, 30, 200, 4000]) for _ in range(250)}
    words |= {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "x" * 30_000: 5, "x" * 29_999 + "y": 25}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = V.group(df, 6, 5, block).collect()
    assert sorted(str(tuple(r)) for r in got) == grouped(words, 5)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = grouped(words_of(rows, 6, 5), 5)
    assert sorted(str(tuple(r)) for r in op12_variants(spark, FOLDER).collect()) == want and len(want) > 500


def test_odd_rows(spark):
    rows = [(None, "Straße straße ÀÉ×÷ÿabc " * 7, "x"), (None, "Straße straße ÀÉ×÷ÿabc " * 7, "y"), (1, None, "z"), (1, "", "z"), (2, "İstanbul ISTANBULL istanbull İ1234567 " * 9, None), (3, "wörter" * 4_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Word string").selectExpr("*", "1 AS n", "2 AS form")
    words = V.vocabulary(docs, 4, 2)
    assert {r["word"]: r["n"] for r in words.collect()} == words_of([r[:2] for r in rows], 4, 2)
    assert V.group(words, 4, 2).count() == words.count()
    none = V.vocabulary(docs.limit(0))
    assert none.count() == 0 and V.group(none).count() == 0
