"""Every registered query against its SQL, on the smallest test tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from opsgauge.checks.adapters import ADAPTERS, TABLES, adapter, with_adapters
from opsgauge.checks.comparing import compare
from opsgauge.checks.oracle import oracle_sql
from opsgauge.checks.queries import QUERIES
from tests.helpers import executed

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    result = QUERIES[name](spark, sf)
    expected = duck.sql(ORACLE[name])
    problem = compare(
        result.columns, [tuple(row) for row in result.collect()], expected.columns, expected.fetchall()
    )
    assert problem is None
    plan = executed(result)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "CollectLimit"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", sorted(ADAPTERS))
def test_adapter_is_the_same_in_both_engines(spark, sf, duck, name):
    got = adapter(spark, sf, name)
    expected = duck.sql(with_adapters(f"SELECT * FROM {{{name}}}"))
    assert compare(got.columns, [tuple(r) for r in got.collect()], expected.columns, expected.fetchall()) is None


def test_entry_returns_rows(spark):
    result = entry.entry(spark)
    assert result.count() == 7
    assert result.columns[0] == "columnName"
