"""Every relational query against its SQL twin in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from planweft.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def rows(dicts, names):
    return sorted(tuple(norm(r[c]) for c in names) for r in dicts)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found, wanted = df.toArrow().to_pylist(), duck.sql(ORACLE_SQL[name]).to_arrow_table().to_pylist()
    if wanted:
        assert set(df.columns) == set(wanted[0])
    assert rows(found, df.columns) == rows(wanted, df.columns)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
