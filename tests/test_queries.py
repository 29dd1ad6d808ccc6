"""Every query with a statement gives what DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v) + 0.0:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_its_statement(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    right = sorted(tuple(plain(row[columns.index(c)]) for c in order) for row in want.fetchall())
    left = sorted(tuple(plain(row[c]) for c in order) for row in got.collect())
    assert len(left) == len(right)
    assert left == right, next((a, b) for a, b in zip(left, right) if a != b)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_other_queries_run(spark, name):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
