"""Every registered query against DuckDB on the same tables."""

import math
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry
from conftest import TESTDATA
from criteria_engine.plans.oracles import ORACLES
from criteria_engine.plans.queries import QUERIES

SF_DIR = TESTDATA / "sf0.01"
TABLES = ["documents", "labels"]

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def counted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(SF_DIR))
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    expected = want.fetchall()
    assert expected
    assert not any(isinstance(v, float) and math.isnan(v) for row in expected for v in row)
    assert counted(got.columns, got.collect()) == counted(columns, expected)


def test_entry(spark):
    assert entry(spark).count() == 4
