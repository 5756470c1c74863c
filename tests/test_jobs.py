from __future__ import annotations

from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsgauge.functions.calendar import (
    WEEKDAYS,
    decode_packed_datetime,
    format_packed_duration,
    frequency_text,
    padded_time,
    subday_text,
    weekday_bit,
    weekdays,
)
from opsgauge.operators.jobs import decode_schedule, job_run_summary, job_status_report, recent
from tests.helpers import executed, one

FREQUENCIES = [
    ((1, 99, 0, 0), "Once"),
    ((4, 1, 0, 0), "Daily"),
    ((4, 3, 0, 0), "Every 3 days"),
    ((8, 62, 0, 1), "Monday, Tuesday, Wednesday, Thursday, Friday; weekly"),
    ((8, 65, 0, 2), "Sunday, Saturday; every 2 weeks"),
    ((8, 2, 0, 0), None),
    ((8, 0, 0, 1), None),
    ((16, 15, 0, 1), "On day 15 of every 1 months"),
    ((32, 8, 16, 3), "Last Day; every 3 months"),
    ((32, 2, 1, 1), "First Monday; monthly"),
    ((32, 10, 8, 1), "Fourth Weekend; monthly"),
    ((32, 11, 8, 1), None),
    ((32, 1, 3, 1), None),
    ((64, 0, 0, 0), "StartUp"),
    ((128, 0, 0, 0), "Idle"),
    ((256, 0, 0, 0), None),
]


def test_frequency_golden(spark):
    df = spark.createDataFrame([(at, *codes) for at, (codes, _) in enumerate(FREQUENCIES)], "at int, t int, i int, r int, f int")
    text = frequency_text(F.col("t"), F.col("i"), F.col("r"), F.col("f"))
    got = [row.x for row in df.select("at", text.alias("x")).orderBy("at").collect()]
    assert got == [text for _, text in FREQUENCIES]


def test_subday_and_padding(spark):
    df = spark.createDataFrame([(4, 15, 0), (1, 15, 93000), (2, 5, 1234567), (8, 1, None)], "t int, i int, m int")
    got = df.select(subday_text(F.col("t"), F.col("i")).alias("s"), padded_time(F.col("m")).alias("p")).collect()
    assert [tuple(r) for r in got] == [
        ("Every 15 minutes", "000000"),
        ("Once", "093000"),
        ("Every 5 seconds", None),
        ("Every 1 hours", None),
    ]


def test_all_weekday_masks(spark):
    got = spark.range(128).select("id", weekdays(F.col("id").cast("int")).alias("days")).collect()
    for row in got:
        named = [day for bit, day in enumerate(WEEKDAYS) if row.id & (1 << bit)]
        assert row.days == (", ".join(named) or None)
        assert sum(1 << WEEKDAYS.index(day) for day in named) == row.id


def test_weekday_bit():
    assert [weekday_bit(date(2024, 1, day)) for day in range(7, 14)] == [1, 2, 4, 8, 16, 32, 64]


@settings(max_examples=6, deadline=None)
@given(st.datetimes(datetime(1990, 1, 1), datetime(2100, 1, 1)).map(lambda d: d.replace(microsecond=0)))
def test_packed_datetime_round_trip(spark, moment):
    day, time = int(f"{moment:%Y%m%d}"), int(f"{moment:%H%M%S}")
    assert one(spark.range(1), decode_packed_datetime(F.lit(day), F.lit(time))) == moment


def test_packed_values(spark):
    df = spark.range(1)
    assert one(df, decode_packed_datetime(F.lit(20240105), F.lit(93015))) == datetime(2024, 1, 5, 9, 30, 15)
    assert one(df, decode_packed_datetime(F.lit(0), F.lit(0))) is None
    assert one(df, decode_packed_datetime(F.lit(20240230), F.lit(0))) is None
    assert one(df, format_packed_duration(F.lit(150))) == "00:01:50"
    assert one(df, format_packed_duration(F.lit(1234559))) == "123:45:59"
    assert one(df, format_packed_duration(F.lit(None))) is None


HISTORY = [
    # job, instance, step, status, date, time, duration
    ("a", 1, 0, 1, 20240101, 10000, 10),
    ("a", 2, 1, 2, 20240102, 20000, 20),
    ("a", 3, 0, 0, 20240103, 30000, 150),
    ("a", 4, 1, 1, 20240104, 40000, 40),
    ("b", 5, 1, 2, 20240105, 50000, 50),
    ("c", 6, 0, 3, 20240106, 60000, 1000000),
]


def _history(spark):
    return spark.createDataFrame(
        [("s", *row) for row in HISTORY],
        "server string, job_id string, instance_id long, step_id int, run_status int, run_date int, run_time int, run_duration int",
    )


def test_summary(spark):
    got = {row.job_id: tuple(row)[2:] for row in job_run_summary(_history(spark)).collect()}
    assert got == {
        "a": (1, 0, 1, 1, 3, "00:01:50", datetime(2024, 1, 3, 3)),
        "b": (0, 0, 0, 1, None, None, None),
        "c": (0, 1, 0, 0, 6, "100:00:00", datetime(2024, 1, 6, 6)),
    }


def test_summary_combines_in_hash_tables_and_shuffles_once(spark, sf):
    plan = executed(job_run_summary(_history(spark)))
    assert plan.count("Exchange") == 1
    assert plan.count("HashAggregate") == 2
    assert "SortAggregate" not in plan and "Join" not in plan


def _report(spark, **options):
    jobs = spark.createDataFrame(
        [("s", "a", "first", 1), ("s", "b", "second", 1), ("s", "z", "it's", 1), ("s", "off", "disabled", 0)],
        "server string, job_id string, name string, enabled int",
    )
    schedules = spark.createDataFrame(
        [("s", 1, "nightly", 1, 4, 1, 0, 0, 4, 15, 0, 235959), ("s", 2, "gone", 0, 4, 1, 0, 0, 4, 15, 0, 235959)],
        "server string, schedule_id int, name string, enabled int, freq_type int, freq_interval int, freq_relative_interval int, "
        "freq_recurrence_factor int, freq_subday_type int, freq_subday_interval int, active_start_time int, active_end_time int",
    )
    links = spark.createDataFrame(
        [("s", 1, "a", 20240201, 13000), ("s", 2, "b", 20240201, 13000), ("s", 1, "z", 0, 0)],
        "server string, schedule_id int, job_id string, next_run_date int, next_run_time int",
    )
    return job_status_report(jobs, decode_schedule(schedules, links), job_run_summary(_history(spark)), **options)


def test_status_report(spark):
    got = {row.jobID: row.asDict() for row in _report(spark).collect()}
    assert set(got) == {"a", "b", "z"}
    assert got["a"]["scheduleTime"] == "00:00 - 23:59"
    assert got["a"]["nextRunDate"] == "2024/02/01 01:30"
    assert got["a"]["disableSQLScript"] == "EXECUTE msdb.dbo.sp_update_job @job_id = 'a', @enabled = 0;"
    assert (got["b"]["scheduleName"], got["b"]["frequency"], got["b"]["nextRunDate"]) == ("(unscheduled)", "", "")
    assert (got["b"]["lastDuration"], got["b"]["lastExecutionStart"]) == ("00:00:01", None)
    assert got["z"]["success"] == 0 and got["z"]["lastExecutionID"] == 0


def test_report_order_options_and_recent(spark):
    order = [row.nextRunDate for row in _report(spark).collect()]
    assert order == sorted(order)
    status = {row.jobID: row.jobStatus for row in _report(spark, include_disabled=True).collect()}
    assert status["off"] == "Disabled"
    assert [r.jobID for r in recent(_report(spark), datetime(2024, 1, 3)).collect()] == ["a"]
    assert recent(_report(spark), datetime(2024, 1, 3, 3, 0, 1)).count() == 0


@pytest.mark.parametrize("count", [200_000])
def test_hot_job(spark, count):
    """One job with nearly all runs: same counts as computed directly."""
    runs = spark.range(count).select(
        F.lit("s").alias("server"),
        F.when(F.col("id") % 100 == 0, F.col("id").cast("string")).otherwise("hot").alias("job_id"),
        F.col("id").alias("instance_id"),
        (F.col("id") % 2).cast("int").alias("step_id"),
        (F.col("id") % 4).cast("int").alias("run_status"),
        F.lit(20240101).alias("run_date"),
        F.lit(0).alias("run_time"),
        (F.col("id") % 60).cast("int").alias("run_duration"),
    )
    hot = job_run_summary(runs).where("job_id = 'hot'").first()
    ids = [i for i in range(count) if i % 100]
    assert hot.fail == sum(1 for i in ids if i % 4 == 0)
    assert hot.retry == sum(1 for i in ids if i % 4 == 2)
    assert hot.last_execution_id == max(i for i in ids if i % 2 == 0)
