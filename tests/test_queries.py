"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from demesne.plans import registry

DIR = os.environ.get("DEMESNE_TEST_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DIR}/{f}')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (bool, str, datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(float(v))
    return str(v)


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys() and len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in got.collect()]
    res = db.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in res.fetchall()]
    key = lambda r: tuple("" if x is None else x for x in r)
    assert sorted(rows, key=key) == sorted(want, key=key)
