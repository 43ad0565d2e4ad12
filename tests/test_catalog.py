"""Every query with SQL must give what DuckDB gives for it."""

import os

import duckdb
import pytest

from dialoom.plans import catalog, phrases, rules, stored  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return round(float(v), 8) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    expected = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    theirs = sorted((tuple(norm(dict(zip(expected.columns, r, strict=True))[c]) for c in cols) for r in expected.fetchall()), key=str)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
