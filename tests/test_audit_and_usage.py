from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from opsgauge.checks.adapters import adapter
from opsgauge.checks.queries import QUERIES, _definition_inputs
from opsgauge.functions.statements import create_index_statement, describe_index, drop_statement
from opsgauge.operators import audit, fleet, usage
from opsgauge.sources.catalog import latest_snapshot
from opsgauge.sources.logs import append_log, logged_since
from opsgauge.session import working_path
from tests.helpers import executed, one, plan_text, rows

SCOPE = "server string, database_id int, object_id long"


def test_describe_index(spark):
    def text(*values):
        return one(spark.range(1), describe_index(*[F.lit(v) for v in values]))

    assert text(0, False, False, False) == "heap"
    assert text(1, True, True, True) == "clustered, ignore duplicate keys, unique, primary key"
    assert text(5, False, True, False) == "nonclustered, unique"


def test_lists_keep_their_order(spark):
    columns = spark.createDataFrame([("s", 1, 9, c, f"c<{c}>") for c in range(1, 13)], f"{SCOPE}, column_id int, name string")
    used = [("s", 1, 9, 2, c, 13 - c, 13 - c if c % 3 else 0, 1 if c == 4 else 0, c % 3 == 0, c % 2 == 0) for c in range(1, 13)]
    index_columns = spark.createDataFrame(
        used,
        f"{SCOPE}, index_id int, column_id int, index_column_id int, key_ordinal int, partition_ordinal int, "
        "is_included_column boolean, is_descending_key boolean",
    )
    lists = audit.key_and_included_columns(index_columns, columns).first()
    assert lists.indexed_columns == "c<11>, c<10>, c<8>, c<7>, c<5>, c<4>, c<2>, c<1>"
    assert lists.included_columns == "c<12>, c<9>, c<6>, c<3>"
    indexes = spark.createDataFrame(
        [("s", 1, 9, 2, "ix", "NONCLUSTERED", False, True, False, False, None)],
        f"{SCOPE}, index_id int, name string, type_desc string, is_primary_key boolean, is_unique boolean, "
        "is_unique_constraint boolean, has_filter boolean, filter_definition string",
    )
    tables = spark.createDataFrame([("s", 1, 9, "t")], f"{SCOPE}, name string")
    databases = spark.createDataFrame([("s", 1, "db")], "server string, database_id int, name string")
    made = audit.index_definitions(tables, indexes, index_columns, columns, databases).first()
    assert made.indexKeys == "c<11>, c<10> DESC, c<8> DESC, c<7>, c<5>, c<4> DESC, c<2> DESC, c<1>"
    assert (made.includedColumns, made.partitionKeys, made.filterDefinition) == ("c<3>, c<6>, c<9>, c<12>", "c<4>", "")


def test_drift_with_itself_is_empty(spark, sf):
    definitions = audit.index_definitions(**_definition_inputs(spark, sf))
    assert audit.definition_drift(definitions, definitions).count() == 0
    assert audit.definition_differences(definitions, definitions).count() == 0


def test_drift(spark):
    schema = "databaseName string, tableName string, indexName string, keys string, flag boolean"
    a = spark.createDataFrame([("d", "t", "same", "x", True), ("d", "t", None, "x", None), ("d", "t", "old", "x", True)], schema)
    b = spark.createDataFrame([("d", "t", "same", "x", True), ("d", "t", None, "y", True), ("d", "t", "new", "x", True)], schema)
    drift = audit.definition_drift(a, b, fields=["keys", "flag"])
    assert rows(drift) == sorted(
        [("d", "t", None, "changed", "keys, flag"), ("d", "t", "new", "added", ""), ("d", "t", "old", "removed", "")], key=repr
    )
    quick = audit.definition_differences(a, b, a.columns)
    assert quick.count() == 2
    with pytest.raises(ValueError, match="not unique"):
        audit.definition_drift(a.union(a), b, fields=["keys", "flag"])


def test_drift_of_several_servers_and_schemas(spark):
    schema = "serverName string, databaseName string, schemaName string, tableName string, indexName string, keys string"
    fleet = spark.createDataFrame([(s, "d", o, "t", "i", s + o) for s in "xyz" for o in "ab"], schema)
    assert audit.definition_drift(fleet, fleet, fields=["keys"]).count() == 0
    one, other = fleet.where("serverName = 'x'"), fleet.where("serverName = 'y'")
    assert audit.definition_drift(one, other, fields=["keys"]).count() == 4
    assert {r.change for r in audit.definition_drift(one, other, fields=["keys"], across_servers=True).collect()} == {"changed"}


def test_table_filter_limits_what_is_aggregated(spark, sf):
    inputs = _definition_inputs(spark, sf)
    one_table = audit.index_definitions(**inputs, table="Supplier#000000005")
    everything = audit.index_definitions(**inputs).where("tableName = 'Supplier#000000005'")
    assert rows(one_table) == rows(everything) and one_table.count() > 0


def test_statements(spark):
    def drop(kind, unique):
        return one(spark.range(1), drop_statement(*[F.lit(v) for v in (kind, unique, "ix", "db", "sales", "t")]))

    assert drop(2, False) == "Drop Index ix On db.sales.t;"
    assert drop(2, True) == "Alter Table db.sales.t Drop Constraint ix;"
    assert drop(1, False) == ""

    def create(equality, inequality, included):
        parts = [F.lit(v).cast("string") for v in (equality, inequality, included)]
        return one(
            spark.range(1), create_index_statement(F.lit("t"), F.lit(1), F.lit("[d].[s].[t]"), *parts, date(2024, 1, 5))
        )

    assert create("[a]", "[b]", "[c]") == (
        "CREATE NONCLUSTERED INDEX IX_t_missing_20240105_1 ON [d].[s].[t] ([a],[b]) INCLUDE ([c]);"
    )
    assert create(None, "[b]", None) == "CREATE NONCLUSTERED INDEX IX_t_missing_20240105_1 ON [d].[s].[t] ([b]);"


def test_reports_are_ordered(spark, sf):
    reads = [r.total_seekScanLookup for r in QUERIES["usage_report"](spark, sf).collect()]
    assert reads and reads == sorted(reads)
    impacts = [r.est_impact for r in QUERIES["missing_statements"](spark, sf).collect()]
    assert impacts == sorted(impacts, reverse=True)


def _unused_inputs(spark):
    key = "server string, database_id int, object_id long, index_id int"
    indexes = spark.createDataFrame(
        [("s", 1, 1, 2, "a", 2, "NONCLUSTERED", False), ("s", 1, 2, 2, "b", 2, "NONCLUSTERED", False)],
        f"{key}, name string, type int, type_desc string, is_unique boolean",
    )
    used = spark.createDataFrame([("s", 1, 1, 2, 0, 0, 0, 7)], f"{key}, user_seeks long, user_scans long, user_lookups long, user_updates long")
    partitions = spark.createDataFrame([("s", 1, 1, 2, 10, 5), ("s", 1, 2, 2, 11, 6), ("s", 1, 2, 2, 12, 7)], f"{key}, partition_id long, rows long")
    objects = spark.createDataFrame([("s", 1, 1, "t1", "dbo"), ("s", 1, 2, "t2", "dbo")], f"{SCOPE}, name string, schema_name string")
    databases = spark.createDataFrame([("s", 1, "db")], "server string, database_id int, name string")
    return indexes, used, partitions, objects, databases


def test_unused_and_never_seen(spark):
    inputs = _unused_inputs(spark)
    assert rows(usage.unused(*inputs), "indexName", "user_updates", "row_count", "partitioned") == [("a", 7, 5, "no")]
    assert rows(usage.unused(*inputs, include_never_seen=True), "indexName", "user_updates", "row_count", "partitioned") == [
        ("a", 7, 5, "no"),
        ("b", 0, 13, "yes"),
    ]
    since = datetime(2024, 1, 1)
    dated = (inputs[0], inputs[1].withColumn("stats_since", F.lit(since)), *inputs[2:])
    assert rows(usage.unused(*dated), "indexName", "stats_since") == [("a", since)]


def test_optional_filters_reach_the_scan(spark, sf):
    databases = adapter(spark, sf, "databases")
    stats = spark.read.parquet(f"{sf}/events.parquet").select(
        F.lit("s").alias("server"), F.col("event_id").alias("plan_handle"), F.lit(2).alias("execution_count"),
        F.col("ts").alias("last_execution_time"),
    )
    plan = plan_text(usage.hot_plans(stats, datetime(2024, 1, 20)))
    assert "GreaterThan(ts,2024-01-13T00:00)" in plan
    assert fleet.user_databases(databases, names="nation_4,nation_9").count() == 1


def test_hot_plans_are_strictly_above_the_minimum(spark):
    log = spark.createDataFrame(
        [("s", 1, 1, datetime(2024, 1, 30)), ("s", 2, 1, datetime(2024, 1, 30)), ("s", 2, 1, datetime(2024, 1, 29)),
         ("s", 3, 9, datetime(2024, 1, 24)), ("s", 4, 9, datetime(2024, 1, 24, 0, 0, 1))],
        "server string, plan_handle int, execution_count int, last_execution_time timestamp_ntz",
    )
    assert rows(usage.hot_plans(log, datetime(2024, 1, 31)), "plan_handle", "statement_executions") == [(2, 2), (4, 9)]


def test_plans_that_suggest_an_index(spark):
    xml = {
        1: '<ShowPlanXML xmlns="http://a"><S><MissingIndex Database="d"/></S></ShowPlanXML>',
        2: '<ShowPlanXML xmlns="http://a"><S>MissingIndex</S></ShowPlanXML>',
        3: '<ShowPlanXML><MissingIndex Database="d"/>',
        4: "not xml",
        5: '<ShowPlanXML><MissingIndex Table="t"/></ShowPlanXML>',
        6: '<a><b><MissingIndex Database=""/></b></a>',
        7: None,
    }
    plans = spark.createDataFrame(
        [("s", 1, at, at, text) for at, text in xml.items()] + [("s", 1, None, 8, xml[1])],
        f"{SCOPE}, plan_handle int, query_plan string",
    )
    hot = spark.range(1, 9).select(F.lit("s").alias("server"), F.col("id").cast("int").alias("plan_handle"), F.lit(5).alias("statement_executions"))
    assert rows(usage.plans_with_missing_index(hot, plans), "plan_handle") == [(1,), (6,)]


def test_missing_candidates_of_one_database(spark, sf):
    inputs = {
        "groups": adapter(spark, sf, "missing_groups"),
        "group_stats": adapter(spark, sf, "missing_group_stats"),
        "details": adapter(spark, sf, "missing_details"),
        "tables": adapter(spark, sf, "nation_tables"),
    }
    got = usage.missing_candidates(**inputs, database_id=3, min_impact=0)
    assert {r.affected_table for r in got.collect()} == {"NATION_3"}
    top = usage.missing_candidates(**inputs, database_id=3, min_impact=0, top_k=1)
    assert rows(top) == rows(got.where("rank = 1").select(top.columns))


def test_a_log_shows_what_was_added_since(spark):
    path = working_path(spark, "log")
    for day in (1, 2, 3):
        frame = spark.createDataFrame([(day, datetime(2024, 1, day, 12))], "n int, at timestamp_ntz")
        append_log(frame, path, "at", f"run {day}")
    append_log(frame, path, "at", "run 3")  # repeated: logged once
    found = logged_since(spark, path, "n int, at timestamp_ntz", "at", datetime(2024, 1, 2, 12))
    assert rows(found, "n") == [(2,), (3,)]
    empty = working_path(spark, "log")
    append_log(frame.where("false"), empty, "at", "none")
    assert logged_since(spark, empty, "n int, at timestamp_ntz", "at", datetime(2024, 1, 1)).count() == 0
    assert "PartitionFilters: [isnotnull(log_day" in plan_text(found)


def test_only_hot_plans_are_parsed(spark, sf):
    hot = usage.hot_plans(adapter(spark, sf, "query_stats"), datetime(2024, 1, 30), 20, 25)
    found = usage.plans_with_missing_index(hot, adapter(spark, sf, "query_plans"))
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(at for at, line in enumerate(lines) if "Join" in line)
    assert [at for at, line in enumerate(lines) if "XPath" in line] and not any("XPath" in line for line in lines[join + 1 :])


def test_latest_snapshot(spark):
    frame = spark.createDataFrame(
        [("s", 1, datetime(2024, 1, 1), "old"), ("s", 1, datetime(2024, 1, 3), "new"), ("s", 2, datetime(2024, 1, 2), "only")],
        "server string, database_id int, snapshot_ts timestamp_ntz, v string",
    )
    assert rows(latest_snapshot(frame), "v") == [("new",), ("only",)]
    assert rows(latest_snapshot(frame, datetime(2024, 1, 2)), "v") == [("old",), ("only",)]


def test_for_each_database_is_one_plan(spark, sf):
    databases = adapter(spark, sf, "databases").where("database_id < 3")
    frames = {"partitions": adapter(spark, sf, "partitions")}
    got = fleet.for_each_database(usage.partition_rollup, frames, databases)
    expected = usage.partition_rollup(frames["partitions"]).where("database_id < 3")
    assert rows(got) == rows(expected) and got.count() > 0
    other = spark.range(3)
    assert fleet.for_each_database(lambda plain: plain, {"plain": other}, databases) is other


@pytest.mark.parametrize("name", ["job_run_summary", "usage_report", "plan_log_missing", "maintenance_actions"])
def test_no_python_in_the_plans(spark, sf, name):
    assert "Python" not in executed(QUERIES[name](spark, sf))
