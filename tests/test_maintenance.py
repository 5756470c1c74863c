from __future__ import annotations

from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsgauge.checks.adapters import adapter
from opsgauge.operators import maintenance as m
from opsgauge.plans.maintenance import maintenance_plan, maintenance_run, scan_status
from tests.helpers import executed, rows

KEY = "server string, database_id int, object_id long, index_id int, partition_number int"


def test_settings_fall_back():
    assert m.MaintenanceSettings(-1, 101, "size", "up", None, None, None, 3600, force_rescan=None).validated() == (
        m.MaintenanceSettings(10.0, 30.0, "range_scan_count", "DESC", 8, None, None, 5)
    )
    kept = m.MaintenanceSettings(0, 100, "page_count", "asc", 0, 5, 1, 0, True, True)
    assert kept.validated() == kept


def _physical(spark):
    data = [
        # object, index, partition, level, fragmentation, pages
        (1, 1, 1, 0, 10.0, 9),
        (1, 1, 2, 0, 9.9, 9),
        (1, 1, 3, 0, 50.0, 8),
        (1, 0, 1, 0, 50.0, 99),
        (2, 1, 1, 0, 60.0, 20),
        (2, 1, 1, 0, 70.0, 30),
        (2, 1, 1, 1, 80.0, 40),
        (3, 1, 1, 0, 60.0, 20),
    ]
    return spark.createDataFrame(
        [("s", 1, *row) for row in data],
        f"{KEY}, index_level int, avg_fragmentation_in_percent double, page_count long",
    )


def _operational(spark):
    units = [(1, 1, 1, 5), (1, 1, 2, 5), (1, 1, 3, 5), (1, 0, 1, 5), (2, 1, 1, 7)]
    return spark.createDataFrame([("s", 1, *u) for u in units], f"{KEY}, range_scan_count long")


def test_scan_takes_leaf_units_that_are_fragmented_and_large(spark):
    got = m.scan_candidates(_physical(spark), _operational(spark))
    assert rows(got, "object_id", "fragmentation", "page_count", "range_scan_count") == [(1, 10.0, 9, 5), (2, 130.0, 50, 7)]


def _units(spark, units):
    return spark.createDataFrame([("s", 1, *u) for u in units], KEY)


def test_latest_populated_partition_is_left_out(spark):
    candidates = _units(spark, [(1, 1, 1), (1, 1, 2), (1, 1, 3), (2, 1, 1), (3, 1, 1), (3, 1, 2)])
    partitions = spark.createDataFrame(
        [("s", 1, 1, 1, 1, 5), ("s", 1, 1, 1, 2, 5), ("s", 1, 1, 1, 3, 0), ("s", 1, 2, 1, 1, 5), ("s", 1, 3, 1, 1, 5), ("s", 1, 3, 1, 2, 0)],
        f"{KEY}, rows long",
    )
    got = m.exclude_latest_partition(candidates, partitions)
    assert rows(got, "object_id", "partition_number") == [(1, 1), (1, 3), (2, 1), (3, 1), (3, 2)]


def test_calendar(spark):
    units = _units(spark, [(1, 1, 1), (2, 1, 1), (3, 1, 1)])
    exclusions = spark.createDataFrame(
        [("s", 1, 1, 1, 65), ("s", 1, 2, 1, 2), ("s", 1, 2, 1, 4), ("s", 1, 9, 1, 127)],
        "server string, database_id int, object_id long, index_id int, exclusionMask int",
    )
    masked = m.apply_exclusion_mask(units, exclusions)
    assert rows(masked, "object_id", "exclusionMask") == [(1, 65), (2, 6), (3, 0)]
    eligible = {day: [r.object_id for r in m.eligible_on(masked, date(2024, 1, day)).orderBy("object_id").collect()] for day in range(7, 14)}
    assert eligible == {7: [2, 3], 8: [1, 3], 9: [1, 3], 10: [1, 2, 3], 11: [1, 2, 3], 12: [1, 2, 3], 13: [2, 3]}


def test_pending_and_rescan(spark):
    status = spark.createDataFrame(
        [(1, None, False, 8), (2, None, True, 9), (3, datetime(2024, 1, 1), True, 9), (4, None, False, 7), (5, None, False, 30)],
        "id int, defragDate timestamp_ntz, printStatus boolean, page_count long",
    )
    assert rows(m.pending(status), "id") == [(1,), (2,), (5,)]
    assert rows(m.pending(status, max_size=9, print_only=True), "id") == [(1,)]
    assert not m.needs_rescan(status)
    assert m.needs_rescan(status, force=True)
    assert m.needs_rescan(status.where("defragDate IS NOT NULL"))


def test_size_limits_differ_between_scan_and_pick(spark):
    assert m.scan_candidates(_physical(spark), _operational(spark), 0, 9).count() == 1
    status = spark.createDataFrame([(9, None)], "page_count long, defragDate timestamp_ntz")
    assert m.pending(status, 9).count() == 1


ACTIONS = [
    # locks off, large objects, partitions, fragmentation, action
    (False, False, 1, 29.9, "REORGANIZE"),
    (False, False, 1, 30.0, "REBUILD"),
    (False, True, 1, 29.9, "REORGANIZE"),
    (False, True, 1, 30.0, "REORGANIZE"),
    (False, False, 2, 30.0, "REORGANIZE"),
    (True, False, 1, 29.9, "REBUILD"),
    (True, False, 1, 30.0, "REBUILD"),
    (True, True, 1, 29.9, "SKIP"),
    (True, False, 2, 30.0, "SKIP"),
    (False, False, 0, 30.0, "REBUILD"),
]


def test_actions_golden(spark):
    df = spark.createDataFrame(
        [(at, *row) for at, row in enumerate(ACTIONS)],
        "at int, page_locks_off boolean, has_lob boolean, partition_count long, fragmentation double, expected string",
    )
    got = df.select("at", "expected", m.action_for(30.0).alias("action")).collect()
    assert [row.action for row in got] == [row.expected for row in got]


def test_flags_are_joined_in(spark):
    candidates = _units(spark, [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 1)]).withColumn("fragmentation", F.lit(40.0))
    partitions = _units(spark, [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 1)])
    columns = spark.createDataFrame(
        [("s", 1, 2, 35, 16), ("s", 1, 2, 167, -1), ("s", 1, 3, 56, 4)],
        "server string, database_id int, object_id long, system_type_id int, max_length int",
    )
    indexes = spark.createDataFrame(
        [("s", 1, 2, 1, False), ("s", 1, 3, 1, False), ("s", 1, 1, 1, True)],
        "server string, database_id int, object_id long, index_id int, allow_page_locks boolean",
    )
    got = m.choose_action(candidates, partitions, columns, indexes)
    assert rows(got, "object_id", "partition_number", "partition_count", "has_lob", "page_locks_off", "action") == [
        (1, 1, 2, False, False, "REORGANIZE"),
        (1, 2, 2, False, False, "REORGANIZE"),
        (2, 1, 1, True, True, "SKIP"),
        (3, 1, 1, False, True, "REBUILD"),
    ]


def test_budget_golden(spark):
    queue = spark.createDataFrame([(1, 5), (2, 4), (3, 3)], "priority int, seconds int")
    got = m.within_budget(queue, F.col("seconds"), minutes=8 / 60)
    assert rows(got, "priority", "seconds_before") == [(1, 0), (2, 5)]
    assert m.within_budget(queue, F.col("seconds"), minutes=None).count() == 3
    paused = m.within_budget(queue, F.col("seconds"), minutes=8 / 60, pause_seconds=3)
    assert rows(paused, "priority", "seconds_before") == [(1, 0)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=30), st.integers(1, 200))
def test_budget_takes_a_prefix(spark, costs, budget):
    queue = spark.createDataFrame(list(enumerate(costs)), "priority int, cost int")
    got = rows(m.within_budget(queue, F.col("cost"), minutes=budget / 60), "priority")
    expected = [at for at in range(len(costs)) if sum(costs[:at]) < budget]
    assert sorted(row[0] for row in got) == expected


def test_priority_orders(spark):
    units = _units(spark, [(1, 1, 1), (2, 1, 1), (3, 1, 1)]).withColumns(
        {"page_count": F.col("object_id") % 2, "range_scan_count": -F.col("object_id")}
    )
    down = m.prioritize(units, "page_count", "desc").orderBy("priority").collect()
    assert [row.object_id for row in down] == [1, 3, 2]
    up = m.prioritize(units, "range_scan_count", "ASC").orderBy("priority").collect()
    assert [row.object_id for row in up] == [3, 2, 1]
    with pytest.raises(ValueError):
        m.prioritize(units, "object_id")
    with pytest.raises(ValueError):
        m.prioritize(units, "page_count", "sideways")


LOG = [
    ("r1", 1, "started", datetime(2024, 1, 1, 0, 0, 0, 900000), None),
    ("r1", 1, "finished", datetime(2024, 1, 1, 0, 0, 5, 100000), None),
    ("r1", 2, "started", datetime(2024, 1, 1, 1), None),
    ("r1", 2, "failed", datetime(2024, 1, 1, 1, 0, 9), "no space"),
    ("r1", 3, "started", datetime(2024, 1, 1, 2), None),
    ("r1", 3, "failed", datetime(2024, 1, 1, 2, 1), "locked"),
    ("r1", 3, "started", datetime(2024, 1, 1, 3), None),
    ("r1", 3, "finished", datetime(2024, 1, 1, 3, 0, 7), None),
    ("r1", 4, "started", datetime(2024, 1, 1, 4), None),
    ("r1", 5, "started", datetime(2024, 1, 1, 5), None),
    ("r1", 5, "finished", datetime(2024, 1, 1, 5), None),
]


def _log(spark):
    return spark.createDataFrame(
        [(run, "s", 1, 1, 1, unit, event, at, error) for run, unit, event, at, error in LOG],
        f"run_id string, {KEY}, event string, event_ts timestamp_ntz, error_message string",
    )


def test_log_state(spark):
    got = rows(m.maintenance_state(_log(spark)), "partition_number", "status", "durationSeconds", "errorMessage")
    assert got == [
        (1, "DONE", 5, None),
        (2, "FAILED", -1, "no space"),
        (3, "DONE", 7, None),
        (4, "RUNNING", None, None),
        (5, "DONE", 0, None),
    ]


def test_log_summary_retry_and_estimates(spark):
    log = _log(spark)
    done = m.maintenance_summary(log, datetime(2024, 1, 1, 1)).collect()
    assert [row.partition_number for row in done] == [2, 3, 5]
    done = m.maintenance_summary(log, datetime(2024, 1, 1, 1), include_failed=False).collect()
    assert [row.partition_number for row in done] == [3, 5]
    assert rows(m.to_retry(log), "partition_number", "errorMessage") == [(2, "no space")]
    assert rows(m.estimates(log), "partition_number", "est_seconds") == [(1, 5), (3, 7), (5, 0)]


def test_the_whole_log_is_combined_in_hash_tables(spark, sf):
    log = adapter(spark, sf, "maintenance_log")
    plan = executed(m.maintenance_state(log))
    # Only the failed events, which carry texts, may be sorted for their aggregate.
    assert plan.count("SortAggregate") <= 2 and plan.count("HashAggregate") >= 2


def test_names_are_quoted_and_heaps_unnamed(spark, sf):
    candidates = _units(spark, [(2, 3, 1), (2, 0, 1)]).withColumns({"server": F.lit("east"), "database_id": F.lit(2)})
    names = {n: adapter(spark, sf, n) for n in ("objects", "indexes", "schemas", "databases")}
    got = {row.index_id: row for row in m.resolve_names(candidates, **names).collect()}
    assert (got[3].databaseName, got[3].schemaName, got[3].indexName) == ("[model]", "[od]]d]", "[ix_2_3]")
    assert got[0].indexName is None


def test_commands(spark):
    planned = spark.createDataFrame(
        [("REORGANIZE", 2, 7), ("REORGANIZE", 1, 1), ("REBUILD", 1, 1), ("SKIP", 1, 1)],
        "action string, partition_count long, partition_number int",
    ).withColumns({c: F.lit(f"[{c[:2]}]") for c in ("databaseName", "schemaName", "objectName", "indexName")})
    assert [row.sql_statement for row in m.render_commands(planned).collect()] == [
        "ALTER INDEX [in] ON [da].[sc].[ob] REORGANIZE PARTITION = 7",
        "ALTER INDEX [in] ON [da].[sc].[ob] REORGANIZE",
        "ALTER INDEX [in] ON [da].[sc].[ob] REBUILD WITH (ONLINE = Off, SORT_IN_TEMPDB = ON)",
        None,
    ]


def test_plan_numbers_every_unit_once(spark, sf):
    frames = {n: adapter(spark, sf, n) for n in ("partitions", "columns", "indexes", "exclusions")}
    # Units are small at this scale, so the size limit goes down.
    settings_ = m.MaintenanceSettings(min_size=0, order_by="fragmentation")
    plan = maintenance_plan(
        adapter(spark, sf, "index_physical"), adapter(spark, sf, "index_operational"), **frames,
        as_of=date(2024, 1, 7), settings=settings_,
    ).orderBy("priority").collect()
    assert [row.priority for row in plan] == list(range(1, len(plan) + 1)) and plan
    fragmentation = [row.fragmentation for row in plan]
    assert fragmentation == sorted(fragmentation, reverse=True)
    assert {row.action for row in plan} <= {"REORGANIZE", "REBUILD", "SKIP"}


def test_a_lob_counts_for_indexes_without_partitions(spark):
    """A unit whose index is in neither catalog has no flags, one with a lock setting has them."""
    candidates = _units(spark, [(2, 1, 1), (4, 1, 1)]).withColumn("fragmentation", F.lit(40.0))
    columns = spark.createDataFrame(
        [("s", 1, 2, 35, 16)], "server string, database_id int, object_id long, system_type_id int, max_length int"
    )
    indexes = spark.createDataFrame(
        [("s", 1, 2, 1, True)], "server string, database_id int, object_id long, index_id int, allow_page_locks boolean"
    )
    got = m.choose_action(candidates, _units(spark, []), columns, indexes)
    assert rows(got, "object_id", "partition_count", "has_lob", "page_locks_off", "action") == [
        (2, 0, True, False, "REORGANIZE"),
        (4, 0, False, False, "REBUILD"),
    ]


def test_a_hot_index_is_decided_like_any_other(spark):
    """One index holds nearly all units."""
    units = spark.range(100_000).select(
        F.lit("s").alias("server"),
        F.lit(1).alias("database_id"),
        F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(1).alias("object_id"),
        F.lit(1).alias("index_id"),
        F.col("id").cast("int").alias("partition_number"),
        (F.col("id") % 60).cast("double").alias("fragmentation"),
    )
    columns = spark.createDataFrame([], "server string, database_id int, object_id long, system_type_id int, max_length int")
    indexes = units.select("server", "database_id", "object_id", "index_id").distinct()
    indexes = indexes.withColumn("allow_page_locks", F.lit(True))
    got = m.choose_action(units, units, columns, indexes).groupBy("action").count()
    # Single-partition indexes are rebuilt when heavily fragmented, the hot one never.
    heavy = sum(1 for i in range(0, 100_000, 100) if i % 60 >= 30)
    assert dict(rows(got)) == {"REBUILD": heavy, "REORGANIZE": 100_000 - heavy}


def test_a_run_honours_its_settings(spark, sf):
    inputs = {
        "physical": adapter(spark, sf, "index_physical"),
        "operational": adapter(spark, sf, "index_operational"),
        **{n: adapter(spark, sf, n) for n in ("partitions", "columns", "indexes", "exclusions", "objects", "schemas", "databases")},
    }
    day = date(2024, 1, 7)
    everything = maintenance_run(**inputs, as_of=day).collect()
    assert everything and all(row.sql_statement for row in everything)
    assert [row.priority for row in sorted(everything, key=lambda r: r.priority)] == list(range(1, len(everything) + 1))
    small = maintenance_run(**inputs, as_of=day, settings=m.MaintenanceSettings(max_size=10)).collect()
    assert small and all(row.page_count <= 10 for row in small)
    estimates = adapter(spark, sf, "index_physical").selectExpr(
        "server", "database_id", "object_id", "index_id", "partition_number", "60 AS est_seconds"
    )
    timed = m.MaintenanceSettings(minutes=3, pause_seconds=0)
    assert maintenance_run(**inputs, as_of=day, settings=timed, estimates=estimates).count() == 3
    name = next(row.name for row in inputs["databases"].collect() if row.name not in ("master", "tempdb", "model", "msdb"))
    some = maintenance_run(**inputs, as_of=day, database_names=[name]).collect()
    assert all(row.databaseName == f"[{name}]" for row in some)
    # A status with open units is used as it is; one without them, or force, scans again.
    status = scan_status(*[inputs[n] for n in ("physical", "operational", "partitions", "exclusions")], m.MaintenanceSettings())
    one = status.where("object_id % 2 = 0")
    used = maintenance_run(**inputs, as_of=day, status=one).collect()
    assert {row.object_id % 2 for row in used} == {0}
    done = status.selectExpr("* EXCEPT (defragDate)", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS defragDate")
    assert maintenance_run(**inputs, as_of=day, status=done).count() == len(everything)
    forced = m.MaintenanceSettings(force_rescan=True)
    assert maintenance_run(**inputs, as_of=day, status=one, settings=forced).count() == len(everything)


def test_a_cycle_reads_snapshots_that_are_derived_once(spark, sf, monkeypatch):
    """Four runs read each snapshot several times; none of them goes back to the large tables."""
    from opsgauge.checks import queries

    class Seen(Exception):
        pass

    def first_run(spark, path, run_ts, settings, print_only, **inputs):
        files = {name: rows.inputFiles() for name, rows in inputs.items()}
        raise Seen(files)

    monkeypatch.setattr(queries, "stored_run", first_run)
    with pytest.raises(Seen) as found:
        queries.QUERIES["maintenance_cycle"](spark, sf)
    files = found.value.args[0]
    assert {"physical", "partitions", "columns", "indexes", "estimates"} <= set(files)
    assert all("/snapshot-" in file for names in files.values() for file in names) and all(files.values())
