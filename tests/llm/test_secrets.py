import random
import re

import pytest

from entiform.llm import secrets as S

BITS = ["password", "PASSWD", "Secret", "token", "api_key", "ApiKey", "=", ":", " ", "  ", '"', "'", "abc123XYZ", "s3cr3t/+=", "AKIA", "AKIAABCDEFGH12345", "deadbeef" * 4, "0123456789abcdef" * 3,
        "😀", "é", "\n", "x", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "tok", "en", "K", "ſecret"]


def brute(text, rules):
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.I | re.A if r.ignore_case else 0):
            if len(m[r.group]) >= max(1, r.least):
                out.append((m.start(), k, m.end(), r.kind))
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def holds(query, has):
    if query is True:
        return True
    if isinstance(query, str):
        return query in has
    return (all if query[0] == "and" else any)(holds(q, has) for q in query[1])


def texts(n):
    rng = random.Random(8)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_trigram_queries_hold_for_every_match():
    for text in texts(2000):
        for r in S.RULES:
            for m in re.finditer(r.pattern, text, re.I | re.A if r.ignore_case else 0):
                found = m[0].lower() if r.ignore_case else m[0]
                assert holds(S.trigram_query(r.pattern, r.ignore_case), {found[i:i + 3] for i in range(len(found))}), (r.kind, found)
    assert S.trigram_query("[0-9a-f]+") is True
    assert S.trigram_query("abcd|xyz") == ("or", frozenset({("and", frozenset({"abc", "bcd"})), "xyz"}))


@pytest.mark.parametrize("rules", [S.RULES, S.RULES[2:3]])
def test_equals_regex(spark, rules):
    rows = [(k % 150, t) for k, t in enumerate(texts(300))] + [(None, "token = abcdefgh1"), (None, None), (1, ""), (1, ""), (2, "y " * 60_000 + "secret: 12345678")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ruled", "2 AS Secrets", "3 AS body")
    out = S.scan(df, rules)
    assert out.columns == ["doc_id", "text", "ruled", "body", "secrets"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r["secrets"]] == brute(r["text"], rules)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert S.scan(df.limit(0), rules).count() == 0


def test_many_rules_equal_regex(spark):
    rules = S.RULES + tuple(S.Rule(f"vendor{k}", f"v{k:03d}(?:live|test)_[A-Za-z0-9]{{6,}}", 0, 0, k % 2 == 1) for k in range(200))
    assert len({t for r in rules for t in (S.query_trigrams(S.trigram_query(r.pattern)))}) > 400
    rng = random.Random(3)
    parts = [f"v{k:03d}live_abc123" for k in range(0, 200, 7)] + [f"V{k:03d}TEST_ABCDEF{k}" for k in range(1, 200, 9)] + ["v001liv", "password = abcdefgh", "v199test_zz"]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for k in range(120)] + [(3, None), (None, parts[0])]
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string"), rules).collect()
    assert len(got) == len(rows) and sum(len(r["secrets"]) for r in got) > 150
    for r in got:
        assert [tuple(s) for s in r["secrets"]] == brute(r["text"], rules)
