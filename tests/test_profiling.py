from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsgauge.functions.sizing import profilable_catalog, profilable_columns, required_bytes
from opsgauge.operators.profiling import profile_columns, wasted_space, wasted_space_all
from opsgauge.sources.catalog import catalog_from
from tests.helpers import plan_text, rows


def _required(spark, cases, growth=10, compat=False):
    df = spark.createDataFrame(cases, "at int, high bigint, low bigint")
    needed = required_bytes(F.lit(True), F.col("high"), F.col("low"), F.lit(None), growth, compat)
    return [row.needed for row in df.select("at", needed.alias("needed")).orderBy("at").collect()]


GOLDEN = [
    (231, 0, 1, 1),
    (232, 0, 2, 2),
    (10, -1, 2, 2),
    (29788, 0, 2, 2),
    (29789, 0, 4, 2),
    (1952257860, 0, 4, 4),
    (1952257862, 0, 8, 8),
    (250, 0, 2, 2),
    (None, None, None, 8),
    (5, -32768, 2, 2),
    (5, -32769, 4, 4),
    (5, -2147483648, 4, 8),
]


def test_required_bytes_golden(spark):
    cases = [(at, high, low) for at, (high, low, _, _) in enumerate(GOLDEN)]
    assert _required(spark, cases) == [ours for _, _, ours, _ in GOLDEN]
    assert _required(spark, cases, compat=True) == [original for _, _, _, original in GOLDEN]


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.integers(-(2**62), 2**62), min_size=2, max_size=30),
    st.integers(0, 255),
)
def test_required_bytes_grow_with_maximum_and_growth(spark, highs, growth):
    ordered = sorted(highs)
    cases = [(at, high, 0) for at, high in enumerate(ordered)]
    needed = _required(spark, cases, growth)
    assert needed == sorted(needed)
    more = _required(spark, cases, growth + 50)
    # Negative products shrink, so only counts from 0 are comparable.
    assert all(b >= a for a, b, high in zip(needed, more, ordered) if high >= 0)


def _sample(spark):
    return spark.createDataFrame(
        [(1, 250, "ab  ", None, 1.0), (2, 0, "abcde", None, 2.0), (3, 7, None, None, 3.0)],
        "big bigint, small smallint, `a.text` string, none int, x double",
    )


def test_profile(spark):
    assert rows(profile_columns(_sample(spark))) == sorted(
        [
            ("a.text", "string", None, None, 5, 3, 3),
            ("big", "bigint", 3, 1, None, None, 3),
            ("none", "int", None, None, None, None, 3),
            ("small", "smallint", 250, 0, None, None, 3),
        ],
        key=repr,
    )


def test_profile_reads_the_table_once_and_only_its_columns(spark, sf):
    plan = plan_text(profile_columns(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey", "l_returnflag"]))
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("FileScan") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in physical
    assert "Python" not in physical


def test_profile_of_an_empty_table(spark):
    empty = _sample(spark).where("false")
    assert {row.row_count for row in profile_columns(empty).collect()} == {0}
    total = wasted_space(empty).where("columnName = 'Total'").first()
    assert total.estimatedSpaceSavings is None


def test_wasted_space_total_is_the_sum_of_the_parts(spark):
    result = wasted_space(_sample(spark), {"a.text": 10}, unit="KB").collect()
    by_name = {row.columnName: row for row in result}
    assert by_name["big"].byteReduction == 7
    assert by_name["small"].byteReduction == 0
    assert by_name["a.text"].byteReduction == 5
    assert by_name["none"].byteReduction is None
    assert by_name["Total"].estimatedSpaceSavings == pytest.approx((7 + 5) * 3 / 1024)


def test_growth_beyond_the_type_is_at_risk(spark):
    result = wasted_space(spark.sql("SELECT CAST(120 AS TINYINT) AS b"), percent_growth=150)
    row = result.where("columnName = 'b'").first()
    assert row.byteReduction == -1 and row.at_risk


def test_unknown_unit_and_column_are_refused(spark):
    with pytest.raises(ValueError):
        wasted_space(_sample(spark), unit="XB")
    with pytest.raises(ValueError):
        profile_columns(_sample(spark), ["nope"])
    with pytest.raises(ValueError):
        profile_columns(spark.sql("SELECT 1.5D AS x"))


def test_all_tables_have_totals(spark):
    tables = {"it's": _sample(spark), "two": _sample(spark), "no column": spark.sql("SELECT 1.5D AS x")}
    result = rows(wasted_space_all(tables, {"two": {"a.text": 10}}), "tableName", "columnName", "byteReduction")
    assert ("it's", "Total", None) in result and ("Total", "Total", None) in result
    assert ("two", "a.text", 5) in result and ("it's", "a.text", None) in result
    assert len(result) == 2 * 5 + 1


def test_declared_width_of_char_columns():
    schema = T.StructType(
        [T.StructField("a", T.VarcharType(12)), T.StructField("b", T.CharType(3)), T.StructField("c", T.StringType())]
    )
    assert [c.declared for c in profilable_columns(schema)] == [12, 3, None]


def test_catalog_of_frames(spark):
    frame = spark.sql("SELECT 1 AS a, 'x' AS b, CAST(1 AS DECIMAL(9,2)) AS c, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS d")
    catalog = catalog_from(spark, {"dbo.t": frame}, "db", declared_lengths={"dbo.t": {"b": 7}})
    assert rows(catalog, "column_id", "name", "type", "length", "precision", "scale") == [
        (1, "a", "int", 4, None, None),
        (2, "b", "varchar", 7, None, None),
        (3, "c", "decimal", None, 9, 2),
        (4, "d", "datetime2", None, None, None),
    ]
    assert rows(profilable_catalog(catalog, "dbo.t"), "name") == [("a",), ("b",)]
