"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgauge.checks.adapters import TABLES, adapter, table
from opsgauge.functions.calendar import weekdays
from opsgauge.operators import UNIT, audit, fleet, jobs, latency, maintenance, usage
from opsgauge.operators.advice import plan_suggestions, suggested_indexes
from opsgauge.operators.compaction import compact
from opsgauge.operators.counters import usage_between
from opsgauge.operators.export import export_delimited, render_inserts, sanitize_for_export
from opsgauge.operators.profile_store import merged_profile, merged_wasted_space, stored_states, update_profile
from opsgauge.operators.profiling import profile_columns, wasted_space, wasted_space_all
from opsgauge.operators.splitting import filter_by_list, split_rows
from opsgauge.operators.translation import generate_ddl, translate_types
from opsgauge.plans.compaction import compaction_plan
from opsgauge.plans.maintenance import maintenance_plan, maintenance_run, record_run, stored_run
from opsgauge.plans.missing_plans import log_missing_plans
from opsgauge.session import working_path
from opsgauge.sources import versioned
from opsgauge.sources.layout import layout_stats
from opsgauge.sources.logs import COMPACTION_LOG, MAINTENANCE_LOG, append_log, read_log
from opsgauge.sources.status import current_status
from opsgauge.streaming.latency import ProbeParams, run_probe, stream_latency, stream_session
from opsgauge.streaming.numbering import numbered_latency
from opsgauge.streaming.replay import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINEITEM_WIDTHS = {"l_returnflag": 10, "l_linestatus": 10}
TABLE_WIDTHS = {
    "lineitem": LINEITEM_WIDTHS,
    "part": {"p_name": 55, "p_brand": 10, "p_type": 25},
    "customer": {"c_name": 25, "c_mktsegment": 10},
    "orders": {"o_orderstatus": 1, "o_orderpriority": 15},
    "documents": {"lang": 10},
    "conversations": {"role": 10},
}
SUPPLIER_LIST = " Supplier#000000003,,Supplier#000000007 ,Supplier#000000042,nobody,Supplier#000000003"
SUNDAY = date(2024, 1, 7)
POSTS_PER_BATCH = 500_000
HISTORY_RUN = datetime(2024, 2, 1, 12, 0)
PURGE_CUTOFF = datetime(2024, 1, 15, 12, 0)
HOUR_CUTOFF = datetime(2024, 1, 15, 12, 37, 20)
PERIOD_START, PERIOD_END = datetime(1995, 5, 31, 12), datetime(2001, 2, 28, 12)


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def _inputs(spark: SparkSession, sf: str, *names: str, **tables: DataFrame) -> dict[str, DataFrame]:
    return {name: adapter(spark, sf, name, **tables) for name in names}


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    return usage.with_schema_names(adapter(spark, sf, "objects"), adapter(spark, sf, "schemas"))


# Profiling


@query("wasted_space_lineitem")
def wasted_space_lineitem(spark, sf):
    return wasted_space(table(spark, sf, "lineitem"), LINEITEM_WIDTHS)


@query("wasted_space_all")
def wasted_space_everytable(spark, sf):
    tables = {name: table(spark, sf, name) for name in TABLES}
    return wasted_space_all(tables, TABLE_WIDTHS, unit="KB")



@query("wasted_space_compat")
def wasted_space_compat(spark, sf):
    return wasted_space(table(spark, sf, "orders"), TABLE_WIDTHS["orders"], 25, "KB", compat=True)


@query("profile_strings")
def profile_strings(spark, sf):
    return profile_columns(table(spark, sf, "documents"), ["text", "lang", "source"])


@query("profile_lineitem")
def profile_lineitem(spark, sf):
    return profile_columns(table(spark, sf, "lineitem"))


def _grown_profile(spark, sf):
    """States of a table that is profiled, grows by its later years and is profiled again."""
    data, states = working_path(spark, "by-year"), working_path(spark, "profile-states")
    rows = table(spark, sf, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    for added in ("ship_year < 1996", "ship_year >= 1996 OR ship_year IS NULL"):
        rows.where(added).write.mode("append").partitionBy("ship_year").parquet(data)
        update_profile(spark.read.parquet(data), states, "ship_year", declared_lengths=LINEITEM_WIDTHS)
    return stored_states(spark, states)


@query("profile_merged")
def profile_merged(spark, sf):
    return merged_profile(_grown_profile(spark, sf))


@query("wasted_space_merged")
def wasted_space_merged(spark, sf):
    return merged_wasted_space(_grown_profile(spark, sf))


# Splitting and list filters


@query("split_documents")
def split_documents(spark, sf):
    return split_rows(table(spark, sf, "documents"), "text", ",", ["doc_id"], with_pos=True)


@query("split_words")
def split_words(spark, sf):
    words = split_rows(table(spark, sf, "documents"), "text", " ", ["lang"])
    return words.groupBy("lang").agg(
        F.count(F.lit(1)).alias("words"), F.sum(F.length("stringValue")).alias("characters")
    )


@query("split_filter_list")
def split_filter_list(spark, sf):
    return filter_by_list(table(spark, sf, "supplier"), "s_name", SUPPLIER_LIST)


# Export and rendering


@query("export_sanitized")
def export_sanitized(spark, sf):
    documents = table(spark, sf, "documents")
    return sanitize_for_export(documents, not_null=["source"], widths={"source": 4})


@query("export_delimited_files")
def export_delimited_files(spark, sf):
    customers = table(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    clean = sanitize_for_export(customers, "#", not_null=["c_name"], widths={"c_name": 5})
    path = working_path(spark, "export")
    export_delimited(clean, path, "#")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in clean.dtypes)
    return spark.read.schema(schema).option("sep", "#").option("quote", "").csv(path)


@query("render_inserts_part")
def render_inserts_part(spark, sf):
    parts = table(spark, sf, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(18,2)"))
    return render_inserts(parts, "mart.tmp_part")


@query("render_inserts_events")
def render_inserts_events(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.col("value").cast("decimal(18,2)").alias("value"),
        F.when(F.col("event_type") != "view", F.col("props")).alias("props"),
    )
    return render_inserts(events, "mart.tmp_events")


# Schema translation


@query("translated_types")
def translated_types(spark, sf):
    catalog = adapter(spark, sf, "fleet_columns")
    return translate_types(catalog).select(
        "server", "database", "table", "column_id", "type", "target_type", "null_clause"
    )


@query("ddl_from_catalog")
def ddl_from_catalog(spark, sf):
    return generate_ddl(adapter(spark, sf, "fleet_columns"), "mart")


@query("ddl_compat")
def ddl_compat(spark, sf):
    return generate_ddl(adapter(spark, sf, "fleet_columns"), "mart", compat=True)


# Definition audit


@query("key_and_included_columns")
def key_and_included_columns(spark, sf):
    return audit.key_and_included_columns(**_inputs(spark, sf, "index_columns", "columns"))


@query("index_inventory")
def index_inventory(spark, sf):
    inputs = _inputs(spark, sf, "indexes", "partitions", "index_columns", "columns")
    return audit.index_inventory(
        tables=adapter(spark, sf, "objects"),
        schemes=adapter(spark, sf, "partition_schemes"),
        functions=adapter(spark, sf, "partition_functions"),
        **inputs,
    )


def _definition_inputs(spark, sf, **tables):
    inputs = _inputs(spark, sf, "indexes", "index_columns", "columns", "databases", "schemas", **tables)
    return {"tables": adapter(spark, sf, "objects"), **inputs}


@query("index_definitions")
def index_definitions(spark, sf):
    return audit.index_definitions(**_definition_inputs(spark, sf))


@query("index_definitions_table")
def index_definitionstable(spark, sf):
    return audit.index_definitions(**_definition_inputs(spark, sf), table="Supplier#000000005")


@query("index_definitions_fleet")
def index_definitions_fleet(spark, sf):
    return audit.index_definitions_fleet(**_definition_inputs(spark, sf))


@query("definition_drift")
def definition_drift(spark, sf):
    lines = table(spark, sf, "lineitem")
    environments = [
        audit.index_definitions(
            **_definition_inputs(spark, sf, lineitem=lines.where(F.col("l_linestatus") == status))
        )
        for status in ("F", "O")
    ]
    return audit.definition_drift(*environments)


# Usage and advice


@query("partition_rollup")
def partition_rollup(spark, sf):
    return usage.partition_rollup(adapter(spark, sf, "partitions"))


def _usage_inputs(spark, sf):
    inputs = _inputs(spark, sf, "indexes", "partitions", "databases")
    return {"usage": adapter(spark, sf, "index_usage"), "objects": _objects(spark, sf), **inputs}


@query("usage_report")
def usage_report(spark, sf):
    return usage.usage_report(**_usage_inputs(spark, sf))


@query("usage_report_filtered")
def usage_report_filtered(spark, sf):
    return usage.usage_report(
        **_usage_inputs(spark, sf),
        index_type="UNIQUE NONCLUSTERED",
        min_rows=60,
        max_rows=95,
        min_reads=65,
        max_reads=90,
    )


@query("usage_by_database")
def usage_by_database(spark, sf):
    inputs = _usage_inputs(spark, sf)
    chosen = fleet.user_databases(inputs["databases"], names="nation_4,nation_5,nation_6,nation_7,nation_9")
    return fleet.for_each_database(usage.usage_report, inputs, chosen)


@query("user_databases")
def user_databases(spark, sf):
    return fleet.user_databases(adapter(spark, sf, "databases"))


def _part_inputs(spark, sf):
    return {
        "indexes": adapter(spark, sf, "part_indexes"),
        "usage": adapter(spark, sf, "part_usage"),
        "partitions": adapter(spark, sf, "part_partitions"),
        "objects": adapter(spark, sf, "part_objects"),
        "databases": adapter(spark, sf, "databases"),
    }


@query("unused_parts")
def unused_parts(spark, sf):
    return usage.unused(**_part_inputs(spark, sf))


@query("unused_parts_never_seen")
def unused_parts_never_seen(spark, sf):
    return usage.unused(**_part_inputs(spark, sf), max_reads=1, include_never_seen=True)


def _period_usage(spark, sf):
    return usage_between(adapter(spark, sf, "usage_snapshots"), PERIOD_START, PERIOD_END, bucket="90 days")


@query("usage_between_resets")
def usage_between_resets(spark, sf):
    """Six years across two restarts, from counters that each restart set back."""
    return _period_usage(spark, sf)


@query("unused_between_resets")
def unused_between_resets(spark, sf):
    return usage.unused(**_part_inputs(spark, sf) | {"usage": _period_usage(spark, sf)}, max_reads=12)


def _missing_inputs(spark, sf):
    return {
        "groups": adapter(spark, sf, "missing_groups"),
        "group_stats": adapter(spark, sf, "missing_group_stats"),
        "details": adapter(spark, sf, "missing_details"),
        "tables": adapter(spark, sf, "nation_tables"),
    }


@query("missing_candidates")
def missing_candidates(spark, sf):
    return usage.missing_candidates(**_missing_inputs(spark, sf))


@query("missing_candidates_top")
def missing_candidates_top(spark, sf):
    return usage.missing_candidates(**_missing_inputs(spark, sf), top_k=3)


@query("missing_statements")
def missing_statements(spark, sf):
    return usage.missing_statements(usage.missing_candidates(**_missing_inputs(spark, sf)), date(2024, 1, 5))


def _hot(spark, sf):
    return usage.hot_plans(
        adapter(spark, sf, "query_stats"), datetime(2024, 1, 31), last_executed_in_days=20, min_executions=25
    )


@query("hot_plans")
def hot_plans(spark, sf):
    return _hot(spark, sf)


@query("plan_log_missing")
def plan_log_missing(spark, sf):
    return usage.plans_with_missing_index(_hot(spark, sf), adapter(spark, sf, "query_plans"))


def _suggestions(spark, sf):
    return plan_suggestions(_hot(spark, sf), adapter(spark, sf, "advice_plans"))


@query("plan_suggestions")
def plan_suggestion_rows(spark, sf):
    return _suggestions(spark, sf)


@query("suggested_indexes")
def suggested_index_totals(spark, sf):
    return suggested_indexes(_suggestions(spark, sf))


@query("missing_plan_log")
def missing_plan_log(spark, sf):
    """Two runs of the log; the second one's rows are returned."""
    path = working_path(spark, "plan-log")
    inputs = [adapter(spark, sf, name) for name in ("query_stats", "query_plans", "databases")]
    inputs.insert(2, _objects(spark, sf))
    for run in (datetime(2024, 1, 30), datetime(2024, 1, 31)):
        logged = log_missing_plans(path, *inputs, run_ts=run, last_executed_in_days=20, min_executions=25)
    return logged


# Maintenance


def _candidates(spark, sf):
    return maintenance.scan_candidates(**_inputs_as(spark, sf, physical="index_physical", operational="index_operational"))


def _inputs_as(spark, sf, **names):
    return {argument: adapter(spark, sf, name) for argument, name in names.items()}


def _stored(spark, rows, name):
    path = working_path(spark, f"snapshot-{name}")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query("maintenance_candidates")
def maintenance_candidates(spark, sf):
    return _candidates(spark, sf)


@query("maintenance_without_latest")
def maintenance_without_latest(spark, sf):
    return maintenance.exclude_latest_partition(_candidates(spark, sf), adapter(spark, sf, "partitions"))


@query("maintenance_calendar")
def maintenance_calendar(spark, sf):
    masked = maintenance.apply_exclusion_mask(_candidates(spark, sf), adapter(spark, sf, "exclusions"))
    return maintenance.eligible_on(masked, SUNDAY)


@query("maintenance_pending")
def maintenance_pending(spark, sf):
    status = adapter(spark, sf, "maintenance_status")
    return maintenance.pending(status, min_size=9, max_size=14, print_only=True).drop("defragDate")


@query("maintenance_queue")
def maintenance_queue(spark, sf):
    return maintenance.prioritize(_candidates(spark, sf), "page_count", "DESC")


@query("maintenance_actions")
def maintenance_actions(spark, sf):
    inputs = _inputs(spark, sf, "partitions", "columns", "indexes")
    decided = maintenance.choose_action(_candidates(spark, sf), **inputs, rebuild_threshold=50)
    named = maintenance.resolve_names(
        decided, **_inputs(spark, sf, "objects", "schemas", "databases"), indexes=inputs["indexes"]
    )
    return maintenance.render_commands(named)


@query("maintenance_plan")
def maintenance_plan_queue(spark, sf):
    return maintenance_plan(
        **_inputs_as(spark, sf, physical="index_physical", operational="index_operational"),
        **_inputs(spark, sf, "partitions", "columns", "indexes", "exclusions"),
        as_of=SUNDAY,
        settings=maintenance.MaintenanceSettings(exclude_latest=True, rebuild_threshold=50.0, order_by="none"),
    )



@query("maintenance_run")
def maintenance_run_queue(spark, sf):
    """A run over the scanned fleet, with a table of what the units took and a budget in minutes."""
    estimates = adapter(spark, sf, "index_physical").select(
        "server", "database_id", "object_id", "index_id", "partition_number", (F.col("page_count") * 3).alias("est_seconds")
    )
    return maintenance_run(
        **_inputs_as(spark, sf, physical="index_physical", operational="index_operational"),
        **_inputs(spark, sf, "partitions", "columns", "indexes", "exclusions", "objects", "schemas", "databases"),
        as_of=SUNDAY,
        settings=maintenance.MaintenanceSettings(rebuild_threshold=50.0, max_size=14, minutes=20, pause_seconds=1),
        estimates=estimates.where("index_id % 2 = 1"),
    )


@query("maintenance_cycle")
def maintenance_cycle(spark, sf):
    """Four runs over a stored status.

    The first two print what fits into 20 minutes, the second from where the first stopped; the third works
    on all units, of which some fail; the fourth finds all done and scans again.
    """
    path, log_path = working_path(spark, "status"), working_path(spark, "cycle-log")
    inputs = _inputs_as(spark, sf, physical="index_physical", operational="index_operational") | _inputs(
        spark, sf, "partitions", "columns", "indexes", "objects", "schemas", "databases"
    )
    inputs["exclusions"] = adapter(spark, sf, "exclusions").where("exclusionMask % 2 = 0")
    # Every run reads all snapshots several times: they are derived once.
    inputs = {name: _stored(spark, rows, name) for name, rows in inputs.items()}
    minute = inputs["physical"].select(*UNIT, F.lit(60).alias("est_seconds"))
    failing = F.when(F.col("object_id") % 7 == 3, F.lit("deadlock"))
    found = []
    for number, (minutes, print_only) in enumerate([(20, True), (20, True), (None, False), (20, True)], 1):
        settings = maintenance.MaintenanceSettings(minutes=minutes, pause_seconds=0)
        run_ts, run_id = datetime(2024, 1, 7, number), f"run{number}"
        queue = stored_run(
            spark, path, run_ts, settings=settings, print_only=print_only, estimates=minute, **inputs
        )
        for _ in range(2):
            record_run(queue, path, run_id, run_ts, log_path, failing, F.col("page_count"), print_only)
        found.append(queue.select(F.lit(run_id).alias("run_id"), *UNIT, "priority", "action"))
    runs = reduce(DataFrame.unionByName, found)
    log = read_log(spark, log_path, MAINTENANCE_LOG)
    states = maintenance.maintenance_state(log).select("run_id", *UNIT, "status", "durationSeconds", "errorMessage")
    left = current_status(spark, path).select(*UNIT, "printStatus", F.col("defragDate").isNotNull().alias("done"))
    return runs.join(states, ["run_id", *UNIT], "left").join(left, list(UNIT))


@query("maintenance_budget")
def maintenance_budget(spark, sf):
    units = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("size"))
    order = [F.desc("size"), F.asc("l_suppkey"), F.asc("l_linenumber")]
    return maintenance.within_budget(units, F.col("size"), minutes=5000 / 60, order=order)


@query("maintenance_budget_by_database")
def maintenance_budget_by_database(spark, sf):
    order = [F.desc("fragmentation"), F.asc("object_id"), F.asc("index_id"), F.asc("partition_number")]
    return maintenance.within_budget(
        _candidates(spark, sf), F.col("page_count"), 5, order, pause_seconds=2, per=["server", "database_id"]
    )


@query("maintenance_log_summary")
def maintenance_log_summary(spark, sf):
    path = working_path(spark, "maintenance-log")
    append_log(adapter(spark, sf, "maintenance_log"), path, "event_ts", "check")
    log = read_log(spark, path, MAINTENANCE_LOG)
    return maintenance.maintenance_summary(log, datetime(2024, 1, 10))


@query("maintenance_estimates")
def maintenance_estimates(spark, sf):
    log = adapter(spark, sf, "maintenance_log")
    return maintenance.estimates(log)


@query("maintenance_retry")
def maintenance_retry(spark, sf):
    return maintenance.to_retry(adapter(spark, sf, "maintenance_log"))


LAYOUT = ["status", "code"]


def _small_files(spark, sf, root):
    """Orders by status and a code that looks like a number, every status spread over several files."""
    code = F.when(F.col("o_orderstatus") == "F", "001").when(F.col("o_orderstatus") == "O", "1.50").otherwise("0")
    orders = table(spark, sf, "orders").withColumns({"status": F.col("o_orderstatus"), "code": code})
    versioned.create(orders.repartition(6, "o_custkey"), root, LAYOUT)


@query("layout_stats")
def layout_report(spark, sf):
    root = working_path(spark, "layout")
    _small_files(spark, sf, root)
    stats = layout_stats(versioned.current_files(spark, root), 1 << 30, LAYOUT)
    return stats.select("status", "page_count", "fragmentation", (F.col("total_bytes") > 0).alias("has_bytes"))



@query("compaction")
def compaction(spark, sf):
    root = working_path(spark, "compaction")
    _small_files(spark, sf, root)
    before = layout_stats(versioned.current_files(spark, root), 1 << 30, LAYOUT)
    compact(spark, before, root, LAYOUT, target_bytes=1 << 30, sort_by=["o_orderkey"])
    after = layout_stats(versioned.current_files(spark, root), 1 << 30, LAYOUT)
    rows = versioned.read_current(spark, root).groupBy(*LAYOUT).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("o_orderkey").alias("key_sum"),
        F.sum("o_custkey").alias("customer_sum"),
    )
    files = before.select(*LAYOUT, F.col("page_count").alias("_before")).join(
        after.select(*LAYOUT, F.col("page_count").alias("_after")), LAYOUT
    )
    return rows.join(files, LAYOUT).select(
        *LAYOUT, "orders", "key_sum", "customer_sum", (F.col("_after") < F.col("_before")).alias("fewer_files")
    )


@query("compaction_plan")
def compaction_planned(spark, sf):
    """Plan the folders, compact them, and report what the log says about each."""
    root, log_path = working_path(spark, "planned"), working_path(spark, "compaction-log")
    _small_files(spark, sf, root)
    files = versioned.current_files(spark, root)
    queue = compaction_plan(files, 1 << 30, LAYOUT, bytes_per_second=1 << 20)
    compact(spark, queue, root, LAYOUT, 1 << 30, log_path=log_path, run_id="r1")
    keys = ("run_id", "directory")
    state = maintenance.maintenance_state(read_log(spark, log_path, COMPACTION_LOG), keys)
    return queue.join(state.withColumnRenamed("status", "state"), "directory").select(
        "run_id", F.col("status"), "page_count", "fragmentation", "priority", "state", "errorMessage"
    )


# Jobs


@query("job_run_summary")
def job_run_summary(spark, sf):
    return jobs.job_run_summary(adapter(spark, sf, "job_history"))


@query("job_last_start")
def job_last_start(spark, sf):
    summary = jobs.job_run_summary(adapter(spark, sf, "job_history"))
    return summary.select("job_id", "last_execution_id", "last_execution_start")


@query("weekday_masks")
def weekday_masks(spark, sf):
    events = table(spark, sf, "events")
    mask = (F.col("event_id") % 128).cast("int")
    return events.select("event_id", mask.alias("mask"), weekdays(mask).alias("days"))


def _schedules(spark, sf):
    return jobs.decode_schedule(**_inputs(spark, sf, "schedules", "job_schedules"))


@query("schedule_text")
def schedule_text(spark, sf):
    every = adapter(spark, sf, "schedules").select(
        "server",
        "schedule_id",
        F.col("schedule_id").cast("string").alias("job_id"),
        F.lit(20240201).alias("next_run_date"),
        F.col("active_start_time").alias("next_run_time"),
    )
    return jobs.decode_schedule(adapter(spark, sf, "schedules"), every)


@query("job_status_report")
def job_status_report(spark, sf):
    summary = jobs.job_run_summary(adapter(spark, sf, "job_history"))
    return jobs.job_status_report(adapter(spark, sf, "jobs"), _schedules(spark, sf), summary)


@query("recent_jobs")
def recent_jobs(spark, sf):
    summary = jobs.job_run_summary(adapter(spark, sf, "job_history"))
    report = jobs.job_status_report(adapter(spark, sf, "jobs"), _schedules(spark, sf), summary)
    since = datetime(2024, 1, 30, 0, 0)
    return jobs.recent(report, since).select("jobID", "lastExecutionID", "lastExecutionStart")


# Latency


def _latency(spark, sf):
    return latency.token_latency(**_inputs(spark, sf, "posts", "receipts"))


@query("token_latency")
def token_latency(spark, sf):
    return _latency(spark, sf)


@query("latency_batch")
def latency_batch(spark, sf):
    return latency.normalize_latency(_latency(spark, sf))


@query("latency_history")
def latency_history(spark, sf):
    path = working_path(spark, "latency")
    measured = _latency(spark, sf)
    for run in (HISTORY_RUN, HISTORY_RUN, datetime(2024, 2, 2, 12, 0)):
        latency.append_monitor(measured, path, run, None, "publisher")
    return latency.read_history(spark, path).drop("monitorDay", "runKey")


@query("latency_purge")
def latency_purge(spark, sf):
    """A history with four runs a day, purged in place."""
    path = working_path(spark, "purge")
    history = adapter(spark, sf, "posts").select(
        F.window("post_ts", "6 hours")["start"].alias("monitorDate"),
        "publication",
        "tracer_id",
    )
    latency.write_history(history.repartition(8, "monitorDate"), path)
    latency.purge_history_table(spark, path, PURGE_CUTOFF)
    return spark.read.parquet(path).drop("monitorDay", "runKey")


@query("latency_purge_hour")
def latency_purge_hour(spark, sf):
    """A streamed history, one folder for each hour and batch, purged within an hour."""
    path = working_path(spark, "purge-hour")
    posts = adapter(spark, sf, "posts").withColumnsRenamed({"post_ts": "monitorDate", "publication": "publicationName"})
    posts = posts.repartition(8, F.hour("monitorDate"), F.to_date("monitorDate"))
    for batch in range(2):
        latency.write_streamed_history(posts.where(F.col("tracer_id") % 2 == batch), path, "stream", batch)
    latency.purge_history_table(spark, path, HOUR_CUTOFF)
    return latency.read_history(spark, path).select("server", "publicationName", "tracer_id", "monitorDate")


def _with_subscriptions(spark, sf):
    posts, receipts = adapter(spark, sf, "posts"), adapter(spark, sf, "deliveries")
    return latency.token_latency(posts, receipts, adapter(spark, sf, "subscriptions"))


@query("subscription_latency")
def subscription_latency(spark, sf):
    """Three subscribers to each publication, of which one stops midway and one never receives."""
    return _with_subscriptions(spark, sf)


@query("latency_sessions")
def latency_sessions(spark, sf):
    """Sessions of posts that are at most a quarter of an hour apart."""
    dated = _with_subscriptions(spark, sf).join(adapter(spark, sf, "posts"), list(latency.TOKEN))
    return latency.latency_report(dated, gap="15 minutes")


def _streamed(spark, sf, receipts_name, transform, end_after="1 HOUR", subscriptions=None):
    """What ``transform`` makes of the streamed latencies, run until all input is read.

    Time must pass the last token for it to be reported, so the posts end with a token that follows
    the others, which is not part of the result.  No receipt follows it.
    """
    source, out, checkpoint = (working_path(spark, name) for name in ("stream-in", "stream-out", "stream-state"))
    params = ProbeParams(bounded=True)
    session = stream_session(spark, params)
    posts, receipts = adapter(spark, sf, "posts"), adapter(spark, sf, receipts_name)
    end = posts.agg((F.max("post_ts") + F.expr(f"INTERVAL {end_after}")).alias("post_ts"))
    end = end.select(F.lit("").alias("server"), F.lit("").alias("publication"), F.lit(-1).cast("bigint").alias("tracer_id"), "post_ts")
    inputs = {
        "posts": (posts.unionByName(end), "post_ts"),
        "receipts": (receipts.withColumn("seen_ts", F.coalesce("subscriber_ts", "distributor_ts")), "seen_ts"),
    }
    timed = {
        name: (
            rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema.fields if f.name.endswith("_ts")}),
            at,
        )
        for name, (rows, at) in inputs.items()
    }
    streams = replay(session, timed, source, POSTS_PER_BATCH)
    if subscriptions is not None:
        subscriptions.write.parquet(f"{source}/subscriptions")
        subscriptions = session.read.parquet(f"{source}/subscriptions")
    running = (
        transform(stream_latency(**streams, params=params, subscriptions=subscriptions))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**params.trigger())
        .start(out)
    )
    run_probe(running, params)
    found = spark.read.parquet(out).where("server <> ''")
    return found.withColumns(
        {name: F.col(name).cast("timestamp_ntz") for name, kind in found.dtypes if kind == "timestamp"}
    )


@query("latency_stream")
def latency_stream(spark, sf):
    """The batch measurement as a stream."""
    return _streamed(spark, sf, "receipts", lambda latencies: latencies)


@query("subscription_stream")
def subscription_stream(spark, sf):
    """Streamed tokens with a row for each subscription, numbered like those of the batch."""
    return _streamed(spark, sf, "deliveries", numbered_latency, subscriptions=adapter(spark, sf, "subscriptions"))


@query("latency_windows_stream")
def latency_windows_stream(spark, sf):
    """Sliding windows over the stream of latencies: a second aggregation after the join."""
    report = partial(latency.latency_report, width="6 hours", slide="3 hours")
    return _streamed(spark, sf, "deliveries", report, "2 DAYS", adapter(spark, sf, "subscriptions"))
