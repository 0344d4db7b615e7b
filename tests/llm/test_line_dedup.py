import random
from collections import Counter

from entiform.llm import line_dedup
from entiform.llm.line_dedup import drop_boilerplate


def brute(rows, ratio, least):
    pages, seen = Counter(r[1] for r in rows), Counter()
    for _, host, text in rows:
        seen.update({(host, x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ")})
    out = []
    for i, host, text in rows:
        if text is None:
            out.append((i, host, None, 0))
            continue
        kept = [x for x in text.split("\n") if not (seen[host, x.strip(" ")] >= least and seen[host, x.strip(" ")] >= ratio * pages[host] and x.strip(" "))]
        out.append((i, host, "\n".join(kept), len(text.split("\n")) - len(kept)))
    return sorted(map(str, out))


def test_equals_brute_force(spark):
    rng = random.Random(4)
    lines = ["menu", " menu ", "footer", "", " ", "\t", "rare é"] + [f"line {k}" for k in range(60)]
    rows = [(k // 2, rng.choice(["a", "a", "a", "b", None, "small"]), rng.choice([None, "", "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))])) for k in range(300)]
    rows += [(None, "a", "menu\nonly here"), (None, "a", "menu\nonly here"), (5, "lone", "menu"), (6, "a", "menu\n" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = drop_boilerplate(df, 0.1, 4)
    assert sorted(str(tuple(r)) for r in out.collect()) == brute(rows, 0.1, 4)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    more = drop_boilerplate(df.selectExpr("*", "1 AS line", "2 AS host", "3 AS cut", "4 AS Lines_Dropped"), 0.1, 4)
    assert more.columns == ["doc_id", "source", "text", "line", "host", "cut", "lines_dropped"] and more.count() == len(rows)
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_more_hosts_than_are_broadcast(spark, monkeypatch):
    """Large hosts get their lines by broadcast, the others by host, with the same result."""
    monkeypatch.setattr(line_dedup, "HOT_HOSTS", 2)
    rng = random.Random(6)
    rows = [(k, rng.choice(["a"] * 6 + ["b", "c", "d", None]), "\n".join(rng.choice(["menu", "foot", *map(str, range(40))]) for _ in range(5))) for k in range(400)]
    out = drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"), 0.2, 3)
    assert sorted(str(tuple(r)) for r in out.collect()) == brute(rows, 0.2, 3)
