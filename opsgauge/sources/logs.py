"""Append-only logs with fixed schemas, laid out by day."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgauge.functions.calendar import moment

LOG_DAY, LOG_RUN = "log_day", "log_run"
FILES_PER_DAY = 4

# Plans whose XML suggests a missing index, one row per plan and run.
PLAN_LOG = (
    "server string, databaseName string, databaseID int, objectName string, objectID bigint, "
    "query_plan string, executionDate timestamp_ntz, statementExecutions bigint"
)

# What happened to a maintenance unit: started, finished or failed.  The start says what
# was found and what was done about it.
MAINTENANCE_LOG = (
    "run_id string, server string, database_id int, object_id bigint, index_id int, partition_number bigint, "
    "event string, event_ts timestamp_ntz, error_message string, "
    "databaseName string, objectName string, indexName string, fragmentation double, page_count bigint, "
    "sql_statement string"
)

# The same for a folder that is compacted.
COMPACTION_LOG = (
    "run_id string, directory string, event string, event_ts timestamp_ntz, error_message string"
)


def append_log(rows: DataFrame, path: str, at: str, run: str) -> None:
    """Add the rows of a run to the log at ``path`` under the day of their ``at`` column.

    A run that is repeated replaces what it logged before.  A day's rows are gathered in few files.
    """
    key = F.regexp_replace(F.lit(run), "[^A-Za-z0-9_.-]", "_")
    dated = rows.withColumns({LOG_DAY: F.to_date(at), LOG_RUN: key})
    salt = F.pmod(F.xxhash64(*[F.col(name) for name in rows.columns]), F.lit(FILES_PER_DAY))
    (
        dated.repartition(LOG_DAY, salt)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(LOG_DAY, LOG_RUN)
        .parquet(path)
    )


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log, also one that has no rows yet."""
    return spark.read.schema(f"{schema}, {LOG_DAY} date, {LOG_RUN} string").parquet(path)


def logged_since(spark: SparkSession, path: str, schema: str, at: str, since: datetime) -> DataFrame:
    """Log rows at or after a moment; earlier days are not read."""
    log = read_log(spark, path, schema)
    recent = (F.col(LOG_DAY) >= F.lit(since.date())) & (F.col(at) >= moment(since, log, at))
    return log.where(recent).drop(LOG_DAY, LOG_RUN)
