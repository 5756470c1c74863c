"""Usage reports and advice from usage statistics and query logs."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgauge.functions.calendar import moment
from opsgauge.functions.statements import create_index_statement, drop_statement, index_type_text
from opsgauge.operators import INDEX, OBJECT, SCOPE
from opsgauge.operators.fleet import REPORT_EXCLUDED
from opsgauge.plans.ordering import ranked, top_in_groups

MISSING_INDEX_PATH = "//MissingIndex/@Database"


def partition_rollup(partitions: DataFrame) -> DataFrame:
    """Rows and partitions per index."""
    return (
        partitions.groupBy(*INDEX)
        .agg(F.sum("rows").alias("row_count"), F.count("partition_id").alias("partition_count"))
        .withColumn("partitioned", F.when(F.col("partition_count") > 1, "yes").otherwise("no"))
    )


def usage_report(
    indexes: DataFrame,
    usage: DataFrame,
    partitions: DataFrame,
    objects: DataFrame,
    databases: DataFrame,
    database: str | None = None,
    index_type: str | None = None,
    min_rows: int | None = None,
    max_rows: int | None = None,
    min_reads: int | None = None,
    max_reads: int | None = None,
    exclude: Iterable[str] = REPORT_EXCLUDED,
) -> DataFrame:
    """Reads and updates of every index, least read first.

    A filter that is None is left out of the plan, so the others reach the scan.
    Indexes without usage or size do not appear.
    """
    kept_databases = databases.where(~F.col("name").isin(*exclude))
    if database is not None:
        kept_databases = kept_databases.where(F.col("name") == database)
    typed = indexes.withColumn("indexType", index_type_text(F.col("is_unique"), F.col("type_desc")))
    if index_type is not None:
        typed = typed.where(F.col("indexType") == index_type)
    read = _between(usage.withColumn("reads", _reads()), F.col("reads"), min_reads, max_reads)
    sizes = _between(partition_rollup(partitions), F.col("row_count"), min_rows, max_rows)
    # The joins on the index come first: all three sides share that partitioning.
    sized = typed.join(read, list(INDEX)).join(sizes, list(INDEX))
    return (
        _named(sized, objects.where(F.col("is_user_table")), kept_databases)
        .select(
            F.col("database_name").alias("databaseName"),
            F.col("object_name").alias("objectName"),
            F.col("name").alias("indexName"),
            "indexType",
            "user_seeks",
            "user_scans",
            "user_lookups",
            F.col("reads").alias("total_seekScanLookup"),
            "user_updates",
            F.col("row_count").alias("rowCounts"),
            _drop().alias("SQL_DropStatement"),
        )
        .orderBy("total_seekScanLookup")
    )


def unused(
    indexes: DataFrame,
    usage: DataFrame,
    partitions: DataFrame,
    objects: DataFrame,
    databases: DataFrame,
    max_reads: int = 0,
    include_never_seen: bool = False,
) -> DataFrame:
    """Plain nonclustered indexes with at most ``max_reads`` reads, most updated first.

    Statistics hold only what was touched since they were reset; with
    ``include_never_seen`` indexes without a row there count as unread.  A
    ``stats_since`` column of the usage snapshot, the moment of that reset, is
    reported so that a short period is noticed.
    """
    candidates = indexes.where((F.col("type") == 2) & ~F.col("is_unique"))
    counters = ("user_seeks", "user_scans", "user_lookups", "user_updates")
    period = [name for name in ("stats_since",) if name in usage.columns]
    counted = usage.select(*INDEX, *counters, *period)
    if include_never_seen:
        seen = candidates.join(counted, list(INDEX), "left")
        seen = seen.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counters})
    else:
        seen = candidates.join(counted, list(INDEX))
    sized = seen.where(_reads() <= max_reads).join(partition_rollup(partitions), list(INDEX))
    return (
        _named(sized, objects, databases)
        .select(
            F.col("object_name").alias("objectName"),
            F.col("name").alias("indexName"),
            index_type_text(F.col("is_unique"), F.col("type_desc")).alias("indexType"),
            *counters,
            "row_count",
            "partitioned",
            *period,
            _drop().alias("SQL_DropStatement"),
        )
        .orderBy(F.desc("user_updates"))
    )


def missing_candidates(
    groups: DataFrame,
    group_stats: DataFrame,
    details: DataFrame,
    tables: DataFrame,
    min_impact: int = 100,
    database_id: int | None = None,
    top_k: int | None = None,
) -> DataFrame:
    """Suggested indexes with an impact above ``min_impact``, ranked within their table.

    The impact is truncated; equal ones rank by handle.  ``top_k`` keeps the best
    of each table, without it every suggestion is ranked however many a table has.
    """
    wanted = details if database_id is None else details.where(F.col("database_id") == database_id)
    impact = ((F.col("user_seeks") + F.col("user_scans")) * F.col("avg_user_impact")).cast("bigint")
    stats = group_stats.withColumn("est_impact", impact).where(F.col("est_impact") > min_impact)
    named_tables = tables.select(*OBJECT, F.col("name").alias("affected_table"))
    candidates = (
        groups.join(
            stats.withColumnRenamed("group_handle", "index_group_handle"), ["server", "index_group_handle"]
        )
        .join(wanted, ["server", "index_handle"])
        .join(named_tables, list(OBJECT))
        .select(
            *SCOPE,
            "affected_table",
            "index_handle",
            "statement",
            "equality_columns",
            "inequality_columns",
            "included_columns",
            "user_seeks",
            "user_scans",
            "est_impact",
            "last_user_seek",
        )
    )
    order = [F.desc("est_impact"), F.asc("index_handle")]
    table = [*SCOPE, "affected_table"]
    if top_k is not None:
        return top_in_groups(candidates, order, table, top_k)
    return ranked(candidates, order, table)


def missing_statements(candidates: DataFrame, as_of: date) -> DataFrame:
    """The ranked suggestions as statements, highest impact first."""
    return candidates.select(
        *SCOPE,
        "affected_table",
        create_index_statement(
            F.col("affected_table"),
            F.col("rank"),
            F.col("statement"),
            F.col("equality_columns"),
            F.col("inequality_columns"),
            F.col("included_columns"),
            as_of,
        ).alias("sql_statement"),
        "user_seeks",
        "user_scans",
        "est_impact",
        "last_user_seek",
    ).orderBy(F.desc("est_impact"))


def hot_plans(
    query_log: DataFrame, as_of: datetime, last_executed_in_days: int = 7, min_executions: int = 1
) -> DataFrame:
    """Plans run recently, and more than ``min_executions`` times in all."""
    since = as_of - timedelta(days=last_executed_in_days)
    return (
        query_log.where(F.col("last_execution_time") > moment(since, query_log, "last_execution_time"))
        .groupBy("server", "plan_handle")
        .agg(F.sum("execution_count").alias("statement_executions"))
        .where(F.col("statement_executions") > min_executions)
    )


def plans_with_missing_index(hot: DataFrame, plans: DataFrame) -> DataFrame:
    """Hot plans of a stored object whose XML suggests a missing index.

    Text that is not XML is dropped.  Plans are first searched for the element's name as text;
    only those that are hot as well are parsed: the test needs a column of the hot
    plans, so it cannot be moved below the join.
    """
    document = F.col("query_plan")
    well_formed = F.expr("from_xml(query_plan, '_corrupt_record string')._corrupt_record IS NULL")
    suggests = F.when(
        (F.col("statement_executions") >= 0) & well_formed, F.xpath_boolean(document, F.lit(MISSING_INDEX_PATH))
    )
    return (
        plans.where(F.col("object_id").isNotNull() & document.contains("MissingIndex"))
        .join(hot, ["server", "plan_handle"])
        .where(F.coalesce(suggests, F.lit(False)))
        .select(*OBJECT, "plan_handle", "query_plan", "statement_executions")
    )


def named_missing_plans(found: DataFrame, objects: DataFrame, databases: DataFrame, run_ts: datetime) -> DataFrame:
    """Plans with missing indexes as log rows: names resolved, stamped with the run."""
    return _named(found, objects, databases).select(
        "server",
        F.col("database_name").alias("databaseName"),
        F.col("database_id").alias("databaseID"),
        F.col("object_name").alias("objectName"),
        F.col("object_id").alias("objectID"),
        "query_plan",
        F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz").alias("executionDate"),
        F.col("statement_executions").alias("statementExecutions"),
    )


def _reads() -> Column:
    return F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups")


def with_schema_names(objects: DataFrame, schemas: DataFrame) -> DataFrame:
    """Objects with the ``schema_name`` the reports put into statements."""
    names = schemas.select(*SCOPE, "schema_id", F.col("name").alias("schema_name"))
    return objects.join(names, [*SCOPE, "schema_id"])


def _named(df: DataFrame, objects: DataFrame, databases: DataFrame) -> DataFrame:
    tables = objects.select(*OBJECT, F.col("name").alias("object_name"), "schema_name")
    owners = databases.select(*SCOPE, F.col("name").alias("database_name"))
    # Databases go into the objects first: the large side is never joined on its database alone.
    return df.join(tables.join(owners, list(SCOPE)), list(OBJECT))


def _drop() -> Column:
    return drop_statement(
        F.col("type"),
        F.col("is_unique"),
        F.col("name"),
        F.col("database_name"),
        F.col("schema_name"),
        F.col("object_name"),
    )


def _between(df: DataFrame, value: Column, low: int | None, high: int | None) -> DataFrame:
    if low is not None:
        df = df.where(value >= low)
    if high is not None:
        df = df.where(value <= high)
    return df
