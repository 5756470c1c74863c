"""The registered text queries against their SQL, where SQL can express them, and their columns."""

from __future__ import annotations

import duckdb
import pytest

from opsgauge.checks.comparing import compare
from opsgauge.llm.oracle import ORACLE
from opsgauge.llm.queries import QUERIES

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    result = QUERIES[name](spark, sf)
    rows = [tuple(row) for row in result.collect()]
    if not name.startswith("op11"):
        whole = "pages" if name.startswith("op8") else "documents"
        assert len(rows) == duck.sql(f"SELECT count(*) FROM {whole}").fetchall()[0][0]
    if name in ORACLE:
        expected = duck.sql(ORACLE[name])
        assert compare(result.columns, rows, expected.columns, expected.fetchall()) is None
