"""Catalogue queries against their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    plain = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(set(entry.catalog.ORACLES)))
def test_matches_sql(spark, sql, name):
    df = entry.catalog.QUERIES[name](spark, DATA)
    got = sql.sql(entry.catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(got.columns, got.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.catalog.FLAGSHIP in entry.queries()
