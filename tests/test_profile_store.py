"""Profiles merged from the states of parts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opsgauge.operators.profile_store import (
    merged_profile,
    merged_wasted_space,
    new_parts,
    profile_states,
    stored_states,
    update_profile,
)
from opsgauge.operators.profiling import profile_columns, wasted_space
from opsgauge.session import working_path
from tests.helpers import executed, rows

SCHEMA = "day date, `a.b` int, name string, empty string, big long, part string"
DAYS = ("2024-01-01", "2024-01-02", None)


def _days(spark, days, factor=1):
    listed = [
        (day, at * factor if at % 3 else None, "x" * (at % 7) + "  ", None, -at * 10**10, "p")
        for number, day in enumerate(days)
        for at in range(10 * number, 10 * number + 10)
    ]
    texts = spark.createDataFrame(listed, SCHEMA.replace("day date", "day string"))
    return texts.withColumn("day", F.col("day").cast("date"))


def _whole(spark, data):
    return spark.read.parquet(data).drop("day")


def test_a_grown_table_profiles_what_is_new(spark):
    data, states = working_path(spark, "data"), working_path(spark, "states")
    widths = {"name": 20}
    for day in DAYS:
        _days(spark, [day], 1 if day else 100).write.mode("append").partitionBy("day").parquet(data)
        df = spark.read.parquet(data)
        fresh = new_parts(df, states, "day")
        assert fresh.count() == 10
        # The condition is on folders alone: files of known days are not opened.
        assert "DataFilters: []" in executed(fresh) and "Filter (" not in executed(fresh)
        update_profile(df, states, "day", declared_lengths=widths)
        merged = merged_profile(stored_states(spark, states))
        assert rows(merged) == rows(profile_columns(_whole(spark, data)))
    found = merged_wasted_space(stored_states(spark, states), 20, "KB")
    assert rows(found) == rows(wasted_space(_whole(spark, data), widths, 20, "KB"))
    # Nothing is new: nothing is read and nothing changes.
    before = rows(stored_states(spark, states))
    assert new_parts(spark.read.parquet(data), states, "day").count() == 0
    update_profile(spark.read.parquet(data), states, "day", declared_lengths=widths)
    assert rows(stored_states(spark, states)) == before


def test_changed_parts_are_profiled_again(spark):
    states = working_path(spark, "states")
    df = _days(spark, DAYS)
    update_profile(df, states, "day")
    changed = df.withColumn("a.b", F.col("`a.b`") + F.when(F.col("day") == "2024-01-02", 1000).otherwise(0))
    update_profile(changed, states, "day", again=changed.where("day = '2024-01-02'"))
    assert rows(merged_profile(stored_states(spark, states))) == rows(profile_columns(changed.drop("day")))


def test_one_part_may_hold_all_rows_and_none_may_exist(spark):
    df = spark.range(1000).selectExpr("id", "1 AS part", "repeat('y', id % 50) AS text")
    assert rows(merged_profile(profile_states(df, "part"))) == rows(profile_columns(df.drop("part")))
    assert rows(profile_states(df, "part", ["part"]), "column", "max") == [("part", 1)]
    states = working_path(spark, "states")
    assert stored_states(spark, states).count() == 0
    update_profile(df.where("id < 0"), states, "part")
    assert merged_profile(stored_states(spark, states)).count() == 0
    with pytest.raises(ValueError, match="no integer"):
        profile_states(df.selectExpr("1.5D AS x", "part"), "part")
