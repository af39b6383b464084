"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and all(callable(f) for f in q.values())


def normal(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(normal, v)) if isinstance(v, (list, tuple)) else None if v is None else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    df = entry.queries()[name](spark, DATA)
    r = c.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(str(tuple(map(normal, x))) for x in r.fetchall())
    assert sorted(str(tuple(normal(x[k]) for k in cols)) for x in df.collect()) == want
