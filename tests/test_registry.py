"""Every query runs on the smallest tables, and those with SQL equal it."""

import os

import duckdb
import pytest

from pagevault.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(told(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = duck.sql(sql)
    assert sorted(res.columns) == columns
    at = [res.columns.index(c) for c in columns]
    assert got == sorted(tuple(told(r[i]) for i in at) for r in res.fetchall())


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())
