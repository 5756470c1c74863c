"""Job-run history, schedules and the job status report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.functions.calendar import (
    decode_packed_datetime,
    format_packed_duration,
    frequency_text,
    moment,
    padded_time,
    subday_text,
)
from opsgauge.functions.statements import disable_job_statement

# Run status codes.
FAILED, SUCCEEDED, RETRIED, CANCELLED = 0, 1, 2, 3


def job_run_summary(history: DataFrame) -> DataFrame:
    """Outcomes and last run per job from one pass over the history.

    Outcomes count whole runs (step 0), retries count any step.  The last run
    is the step-0 row with the highest instance; a job without one has NULLs.
    All aggregates have fixed-size states, so each task combines before the shuffle.
    """
    whole_run = F.col("step_id") == 0
    status = F.col("run_status")
    instance = F.when(whole_run, F.col("instance_id"))

    def of_last(name: str):
        return F.max_by(F.when(whole_run, F.col(name)), instance)

    return (
        history.groupBy("server", "job_id")
        .agg(
            F.count_if((status == SUCCEEDED) & whole_run).alias("success"),
            F.count_if((status == CANCELLED) & whole_run).alias("cancel"),
            F.count_if((status == FAILED) & whole_run).alias("fail"),
            F.count_if(status == RETRIED).alias("retry"),
            F.max(instance).alias("last_execution_id"),
            of_last("run_duration").alias("_duration"),
            of_last("run_date").alias("_date"),
            of_last("run_time").alias("_time"),
        )
        .select(
            "server",
            "job_id",
            "success",
            "cancel",
            "fail",
            "retry",
            "last_execution_id",
            format_packed_duration(F.col("_duration")).alias("last_duration"),
            decode_packed_datetime(F.col("_date"), F.col("_time")).alias("last_execution_start"),
        )
    )


def decode_schedule(schedules: DataFrame, job_schedules: DataFrame) -> DataFrame:
    """Enabled schedules of each job, in words."""
    enabled = schedules.where(F.col("enabled") == 1)
    decoded = enabled.select(
        "server",
        F.col("name").alias("scheduleName"),
        "schedule_id",
        frequency_text(
            F.col("freq_type"),
            F.col("freq_interval"),
            F.col("freq_relative_interval"),
            F.col("freq_recurrence_factor"),
        ).alias("frequency"),
        subday_text(F.col("freq_subday_type"), F.col("freq_subday_interval")).alias("subFrequency"),
        padded_time(F.col("active_start_time")).alias("startTime"),
        padded_time(F.col("active_end_time")).alias("endTime"),
    )
    return decoded.join(job_schedules, ["server", "schedule_id"]).select(
        "server",
        "scheduleName",
        "schedule_id",
        "job_id",
        "frequency",
        "subFrequency",
        "startTime",
        "endTime",
        padded_time(F.col("next_run_time")).alias("nextRunTime"),
        F.rpad(F.col("next_run_date").cast("string"), 8, " ").alias("nextRunDate"),
    )


def job_status_report(
    jobs: DataFrame, schedules: DataFrame, summary: DataFrame, include_disabled: bool = False
) -> DataFrame:
    """Enabled jobs with their decoded schedules and run summary, next run first.

    ``schedules`` comes from ``decode_schedule``, ``summary`` from ``job_run_summary``.
    """
    shown = jobs if include_disabled else jobs.where(F.col("enabled") == 1)

    def hour_minute(name: str):
        return F.concat(F.substring(name, 1, 2), F.lit(":"), F.substring(name, 3, 2))

    day = F.concat_ws(
        "/", F.substring("nextRunDate", 1, 4), F.substring("nextRunDate", 5, 2), F.substring("nextRunDate", 7, 2)
    )
    next_run = F.when(F.col("nextRunDate").isNotNull(), F.concat(day, F.lit(" "), hour_minute("nextRunTime")))
    window = F.concat(hour_minute("startTime"), F.lit(" - "), hour_minute("endTime"))
    counts = ("success", "cancel", "fail", "retry")
    return (
        shown.join(schedules, ["server", "job_id"], "left")
        .join(summary, ["server", "job_id"], "left")
        .select(
            F.col("server").alias("serverName"),
            F.col("job_id").alias("jobID"),
            F.col("name").alias("jobName"),
            F.when(F.col("enabled") == 1, "Enabled").otherwise("Disabled").alias("jobStatus"),
            F.coalesce("scheduleName", F.lit("(unscheduled)")).alias("scheduleName"),
            F.coalesce("frequency", F.lit("")).alias("frequency"),
            F.coalesce("subFrequency", F.lit("")).alias("subFrequency"),
            F.coalesce(window, F.lit("")).alias("scheduleTime"),
            F.coalesce(next_run, F.lit("")).alias("nextRunDate"),
            *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in counts],
            F.coalesce("last_execution_id", F.lit(0).cast("bigint")).alias("lastExecutionID"),
            F.col("last_execution_start").alias("lastExecutionStart"),
            F.coalesce("last_duration", F.lit("00:00:01")).alias("lastDuration"),
            disable_job_statement(F.col("job_id")).alias("disableSQLScript"),
        )
        .orderBy("nextRunDate")
    )


def recent(report: DataFrame, since: datetime) -> DataFrame:
    """Jobs of a status report whose last run started since a moment."""
    return report.where(F.col("lastExecutionStart") >= moment(since, report, "lastExecutionStart"))
