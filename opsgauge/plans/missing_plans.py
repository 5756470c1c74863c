"""Mining a query log for plans that suggest missing indexes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from opsgauge.operators.usage import hot_plans, named_missing_plans, plans_with_missing_index
from opsgauge.sources.logs import PLAN_LOG, append_log, logged_since


def missing_plans(
    query_log: DataFrame,
    plans: DataFrame,
    objects: DataFrame,
    databases: DataFrame,
    run_ts: datetime,
    last_executed_in_days: int = 7,
    min_executions: int = 1,
) -> DataFrame:
    """Plans of stored objects, run lately and often, that would use another index.

    The log is filtered and reduced to distinct plans before any XML is parsed.
    """
    hot = hot_plans(query_log, run_ts, last_executed_in_days, min_executions)
    return named_missing_plans(plans_with_missing_index(hot, plans), objects, databases, run_ts)


def log_missing_plans(path: str, *inputs: DataFrame, run_ts: datetime, **limits: int) -> DataFrame:
    """Add the found plans to the log at ``path`` and return what this run logged.

    A run that is repeated with the same ``run_ts`` logs once.
    """
    found = missing_plans(*inputs, run_ts=run_ts, **limits)
    append_log(found, path, "executionDate", f"{run_ts:%Y%m%d%H%M%S%f}")
    return logged_since(found.sparkSession, path, PLAN_LOG, "executionDate", run_ts)
