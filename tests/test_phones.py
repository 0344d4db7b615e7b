import random

from pyspark.sql import functions as F

from entiform.functions.phone import PLANS, Plan, standardize_phone
from entiform.operators.phones import standardize_phones

COLUMNS = "prio int, iso2 string, calling_code string, idd string, trunk string, nsn string"


def same(spark, plans, raws, isos, seed):
    """Rows of (raw, iso) by the table and by the compiled plans."""
    rng = random.Random(seed)
    rows = [(k, rng.choice(raws), rng.choice(isos)) for k in range(600)]
    df = spark.createDataFrame(rows, "ord bigint, phone_raw string, country_iso string").selectExpr("*", "'x' AS phone", "1 AS nsn")
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(plans)], COLUMNS)
    got = standardize_phones(df, table)
    assert got.columns == ["ord", "phone_raw", "country_iso", "nsn", "phone"]
    want = df.select("ord", standardize_phone(F.col("phone_raw"), F.col("country_iso"), plans).alias("p")).collect()
    by_ord = {r["ord"]: tuple(r["phone"]) for r in got.collect()}
    assert by_ord == {r["ord"]: tuple(r["p"]) for r in want}
    return by_ord


def test_same_as_the_compiled_plans(spark):
    raws = ["6 99 00 11 22", "+237 699 00 11 22", "00237699001122", "237699001122", "N/A", None, "", "+33 1 23 45 67 89", "011 237 699 00 11 22", "1 415 555 2671", "+1 (415) 555-2671",
            "009 234 8031234567", "08031234567", "+2348031234567", "07123456", "+241 07 12 34 56", "699001122 / 233420001", "+999", "2 22 23 45 67"]
    got = same(spark, PLANS, raws, [p.iso2 for p in PLANS] + [None, "XX"], 1)
    assert sum(p[1] for p in got.values()) > 100


def test_many_plans(spark):
    """250 plans with codes that begin alike; the plan of the query does not grow with them."""
    rng = random.Random(9)
    codes = rng.sample([str(c) for c in range(1, 1000) if "0" not in str(c)], 250)
    plans = tuple(Plan(f"P{k}", c, rng.choice(["00", "011", "8"]), rng.choice(["", "0", "1"]), rng.choice(["[1-9][0-9]{5}", "[2-7][0-9]{4,7}"])) for k, c in enumerate(codes))
    raws = [rng.choice(["+", "00", "011", "8", "", "0"]) + rng.choice(codes + [""]) + str(rng.randrange(10**4, 10**8)) for _ in range(400)] + [None]
    got = same(spark, plans, raws, [p.iso2 for p in plans] + [None], 2)
    assert sum(p[1] for p in got.values()) > 50

    def size(n):
        df = spark.createDataFrame([("1", "2")], "phone_raw string, country_iso string")
        table = spark.createDataFrame([(k, *p) for k, p in enumerate(plans[:n])], COLUMNS)
        return len(standardize_phones(df, table)._jdf.queryExecution().optimizedPlan().toString())

    assert size(250) < 1.2 * size(20)


def test_no_plans(spark):
    df = spark.createDataFrame([("+237 699", "CM"), ("699", "CM"), (None, None)], "phone_raw string, country_iso string")
    got = standardize_phones(df, spark.createDataFrame([], COLUMNS)).collect()
    assert {(r["phone_raw"], tuple(r["phone"])) for r in got} == {("+237 699", ("+237699", False, None)), ("699", (None, False, None)), (None, (None, False, None))}
    assert standardize_phones(df.limit(0), spark.createDataFrame([], COLUMNS)).count() == 0
