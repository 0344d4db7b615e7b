import random
import re

from pyspark.sql import functions as F

from entiform import fixed
from entiform.functions import names
from entiform.operators import chains
from entiform.operators.brands import match_brands


def brute(name, brands):
    """The first phrase that stands alone in the name, by ASCII word edges."""
    for prio, brand, phrase in sorted(b for b in brands if b[2]):
        body = re.escape(phrase).replace("\\ ", "[  ]")
        edge = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
        if name is not None and re.search(f"(?i){edge}(?:{body}){edge}", name):
            return brand
    return None


def test_equals_brute_force(spark):
    rng = random.Random(4)
    parts = ["akwa", "la", "falaise", "star", "land", "azalaï", "azalai", "hôtel", "écluse", "best", "b+b", "a.b", "中文", "x_1"]
    brands = [(rng.randrange(30), f"B{k}", rng.choice([" ", " ", "-"]).join(rng.choice(parts) for _ in range(rng.choice([1, 1, 2, 3])))) for k in range(60)] + [(0, "none", None), (0, "empty", "")]
    firms = [rng.choice([" ", " ", "-", "", " & "]).join(rng.choice([str.title, str.upper, str])(rng.choice(parts)) for _ in range(rng.randrange(1, 5))) for _ in range(400)] + [None, "", " ", "STAR LAND"]
    leads = spark.createDataFrame(list(enumerate(firms)), "ord bigint, company_name string").selectExpr("*", "1 AS key", "'old' AS known_brand", "3 AS prio")
    table = spark.createDataFrame(brands, "prio int, name string, phrase string")
    got = match_brands(leads, table)
    assert got.columns == ["ord", "company_name", "key", "prio", "known_brand"]
    rows = {r["ord"]: r["known_brand"] for r in got.collect()}
    assert rows == {k: brute(n, brands) for k, n in enumerate(firms)} and len(set(rows.values())) > 10
    assert match_brands(leads, table.limit(0)).where("known_brand IS NOT NULL").count() == 0
    assert match_brands(leads.limit(0), table).count() == 0


def test_same_as_the_compiled_list(spark):
    words = ["Hilton", "IBIS", "Novotel", "star land", "Starland", "La Falaise", "la roseraie", "Best Western", "hiltons", "Akwa"]
    rng = random.Random(7)
    leads = spark.createDataFrame([(k, f"{rng.choice(words)} {rng.choice(words)}") for k in range(80)], "ord bigint, company_name string")
    plain = [("hilton", 0), ("radisson", 2), ("marriott", 3), ("best western", 4), ("onomo", 5), ("la falaise", 7), ("krystal", 8), ("star land", 9), ("starland", 9), ("la roseraie", 10)]
    plain += [(w, 1) for w in ("ibis", "novotel", "mercure", "pullman", "sofitel", "accor")]
    table = spark.createDataFrame([(k, fixed.KNOWN_BRANDS[k][0], w) for w, k in plain], "prio int, name string, phrase string")
    want = {r["ord"]: r["b"] for r in leads.select("ord", names.known_brand(F.col("company_name")).alias("b")).collect()}
    assert {r["ord"]: r["known_brand"] for r in chains.match_brand(leads, table).collect()} == want


def test_a_hundred_thousand_phrases(spark):
    table = spark.range(100_000).selectExpr("CAST(id AS int) AS prio", "concat('B', id) AS name", "concat('house ', id, CASE WHEN id % 2 = 0 THEN ' palace' ELSE '' END) AS phrase")
    leads = spark.range(3000).selectExpr("id AS ord", "concat('Hotel HOUSE ', id * 31, ' Palace') AS company_name")
    got = match_brands(leads, table)
    assert got.where("known_brand = concat('B', ord * 31)").count() == 3000
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
