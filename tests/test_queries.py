"""Queries against their SQL on the smallest tables, where these are there."""

import math
import os

import pytest

DIR = os.environ.get("INKGAUGE_TESTDATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
entry = pytest.importorskip("__spark_entry__")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else round(float(v), 6)
    return str(v)


def bag(names, rows):
    at = [list(names).index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert bag(df.columns, rows) == bag(want.columns, want.fetchall())


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
