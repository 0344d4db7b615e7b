import random

from pyspark.sql import functions as F

from entiform.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return [(r[2] or "", r[3] or "") for r in rows]


def test_round_trip(spark):
    rng = random.Random(2)
    bits = [*chat.CONTROLS, "\\", "\\\\", "<", "|", "turn", ">", "[", "/INST]", "hi", "\n", "é", "😀", ""]
    rows = [(rng.randrange(40), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "assistant", "system", None, "<|end|>"]),
             rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))])) for _ in range(400)]
    rows += [(None, 1, "user", "a"), (None, 1, "user", "a"), (7, 9, "assistant", "x" * 200_000)]
    done = chat.format_chats(spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1)))
    got = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    assert {r["conv_id"] for r in got} == {r[0] for r in rows}
    for r in got:
        want = expected([x for x in rows if x[0] == r["conv_id"]])
        assert [tuple(t) for t in r["t"]] == want
        assert r["l"] == [t for role, t in want if role == "assistant"]
        runs = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:]))
        assert r["formatted"].count(chat.TURN) == runs == r["formatted"].count(chat.END) and r["formatted"].count(chat.NEXT) == len(want) - runs


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_is_native(spark):
    plan = chat.format_chats(spark.createDataFrame([(1, 1, "user", "a")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
