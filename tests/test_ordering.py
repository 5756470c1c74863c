"""Ranks and totals of groups of any size, against plain Python."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from opsgauge.plans import ordering
from opsgauge.plans.ordering import ranked, top_in_groups
from tests.helpers import executed


def _skewed(spark, count=20_000):
    """A third of the rows in one group, many ties, one NULL group."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, None)
    return spark.range(count).select(
        key.otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 13).alias("score"),
        "id",
        (F.col("id") % 5).alias("cost"),
    )


def _expected(data, grouped):
    groups = defaultdict(list)
    for row in data:
        groups[row.g if grouped else 0].append(row)
    result = {}
    for members in groups.values():
        before = 0
        for place, row in enumerate(sorted(members, key=lambda r: (-r.score, r.id)), start=1):
            result[row.id] = (place, before)
            before += row.cost
    return result


@pytest.mark.parametrize("limit", [1 << 20, 10])
@pytest.mark.parametrize("grouped", [True, False])
def test_rank_and_total(spark, monkeypatch, grouped, limit):
    """With a small and with a large carry-over."""
    monkeypatch.setattr(ordering, "MAX_BROADCAST_BYTES", limit)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = _skewed(spark)
        got = ranked(df, [F.desc("score"), F.asc("id")], ["g"] if grouped else [], "r", {"b": F.col("cost")})
        found = {row.id: (row.r, row.b) for row in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == _expected(df.collect(), grouped)


def test_rank_without_totals_keeps_the_columns(spark):
    df = _skewed(spark, 500)
    got = ranked(df, [F.desc("score"), F.asc("id")], ["g"])
    assert got.columns == [*df.columns, "rank"]
    assert {row.id: row["rank"] for row in got.collect()} == {k: v[0] for k, v in _expected(df.collect(), True).items()}


def test_a_hot_group_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.lit("only").alias("g"), "id")
        got = ranked(df, [F.asc("id")], ["g"])
        sizes = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(row["count"] for row in sizes) < 30_000


def test_top_keeps_few_rows_before_the_shuffle(spark):
    df = _skewed(spark)
    best = top_in_groups(df, [F.desc("score"), F.asc("id")], ["g"], 2, "r")
    expected = {k: v[0] for k, v in _expected(df.collect(), True).items() if v[0] <= 2}
    assert {row.id: row.r for row in best.collect()} == expected
    plan = executed(top_in_groups(df, [F.desc("score"), F.asc("id")], ["g"], 2, "r"))
    assert "WindowGroupLimit" in plan[plan.rindex("Exchange") :]


def test_empty_input(spark):
    df = _skewed(spark, 10).where("false")
    assert ranked(df, [F.asc("id")], [], "r", {"b": F.col("cost")}).collect() == []
