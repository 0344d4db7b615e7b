import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


QUERIES = {n: q for module in entry.LIBRARY for n, q in module.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan and "ArrowEval" not in plan
    cur = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == {n for module in entry.LIBRARY for n in module.ORACLES}
    assert set(QUERIES) <= set(entry.queries())
