import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PLANS = {k: f for plan in entry.PLANS for k, f in plan.QUERIES.items()}
SQL = {k: s for plan in entry.PLANS for k, s in plan.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, duck, name):
    df = PLANS[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in want.columns) for r in rows), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(PLANS) <= set(entry.queries())
