"""All registered queries against their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from wiretide.plans.oracle import ORACLE
from wiretide.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr([row[c] for c in columns]) for row in df.collect())
    result = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = sorted(repr([row[names.index(c)] for c in columns]) for row in result.fetchall())
    assert sorted(names) == columns
    assert got == expected and got


def test_entry(spark):
    assert entry.entry(spark).count() == 134
