"""The maintenance planner: from statistics to a numbered queue of actions."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgauge.operators.maintenance import (
    FAILED,
    FINISHED,
    PRINTED,
    SKIPPED,
    STARTED,
    MaintenanceSettings,
    apply_exclusion_mask,
    choose_action,
    eligible_on,
    exclude_latest_partition,
    needs_rescan,
    pending,
    prioritize,
    render_commands,
    resolve_names,
    scan_candidates,
    unit_events,
    within_budget,
    work_order,
)
from opsgauge.operators import OBJECT, SCOPE, UNIT
from opsgauge.operators.splitting import filter_by_list
from opsgauge.session import working_path
from opsgauge.sources.logs import append_log
from opsgauge.sources.status import current_status, mark_units, store_scan


def maintenance_plan(
    physical: DataFrame,
    operational: DataFrame,
    partitions: DataFrame,
    columns: DataFrame,
    indexes: DataFrame,
    exclusions: DataFrame,
    as_of: date,
    settings: MaintenanceSettings = MaintenanceSettings(),
    estimates: DataFrame | None = None,
) -> DataFrame:
    """All databases in one job: scan, exclude, decide, then number the units that start in time.

    ``estimates`` brings ``est_seconds`` of units for the time budget; a unit without one takes
    ``DEFAULT_SECONDS``.  Without ``estimates`` the budget is not applied.
    """
    chosen = settings.validated()
    status = scan_status(physical, operational, partitions, exclusions, chosen)
    return _queue(status, partitions, columns, indexes, as_of, chosen, estimates)


def scan_status(
    physical: DataFrame, operational: DataFrame, partitions: DataFrame, exclusions: DataFrame, chosen: MaintenanceSettings
) -> DataFrame:
    """The units worth work, with the weekdays on which they rest, none of them done or printed."""
    candidates = scan_candidates(physical, operational, chosen.min_fragmentation, chosen.min_size)
    if chosen.exclude_latest:
        candidates = exclude_latest_partition(candidates, partitions)
    return apply_exclusion_mask(candidates, exclusions).withColumns(
        {"defragDate": F.lit(None).cast("timestamp_ntz"), "printStatus": F.lit(False)}
    )


def maintenance_run(
    physical: DataFrame,
    operational: DataFrame,
    partitions: DataFrame,
    columns: DataFrame,
    indexes: DataFrame,
    exclusions: DataFrame,
    objects: DataFrame,
    schemas: DataFrame,
    databases: DataFrame,
    as_of: date,
    settings: MaintenanceSettings = MaintenanceSettings(),
    status: DataFrame | None = None,
    estimates: DataFrame | None = None,
    database_names: Iterable[str] | None = None,
    table: str | None = None,
    print_only: bool = False,
    rescanned: bool = False,
) -> DataFrame:
    """What one maintenance run would do: the units in work order with names and commands.

    A ``status`` of an earlier scan is used as long as it has units that are not done; otherwise, or
    with ``force_rescan``, everything is scanned again, unless the status was just ``rescanned``.  ``database_names`` and ``table`` limit the run.  What
    rests on the day, is done, was printed (with ``print_only``), has no size in range or does not start
    within the time budget is left out; so is what can be neither reorganised nor rebuilt.
    """
    chosen = settings.validated()
    if status is None or not rescanned and needs_rescan(status, bool(chosen.force_rescan)):
        status = scan_status(physical, operational, partitions, exclusions, chosen)
    if database_names is not None:
        named = filter_by_list(databases, "name", ",".join(database_names)).select(*SCOPE)
        status = status.join(named, list(SCOPE), "left_semi")
    if table is not None:
        status = status.join(objects.where(F.col("name") == table).select(*OBJECT), list(OBJECT), "left_semi")
    queue = _queue(status, partitions, columns, indexes, as_of, chosen, estimates, print_only, skip=False)
    named = resolve_names(queue, objects, indexes, schemas, databases)
    return render_commands(named)


# What a unit takes that was never measured.
DEFAULT_SECONDS = 60


def _queue(
    status: DataFrame,
    partitions: DataFrame,
    columns: DataFrame,
    indexes: DataFrame,
    as_of: date,
    chosen: MaintenanceSettings,
    estimates: DataFrame | None,
    print_only: bool = False,
    skip: bool = True,
) -> DataFrame:
    waiting = pending(status, chosen.min_size, chosen.max_size, print_only)
    today = eligible_on(waiting, as_of).drop("defragDate", "printStatus")
    decided = choose_action(today, partitions, columns, indexes, chosen.rebuild_threshold)
    if not skip:
        decided = decided.where(F.col("action") != "SKIP")
    if estimates is None:
        return prioritize(decided, chosen.order_by, chosen.order)
    timed = decided.join(estimates.select(*UNIT, "est_seconds"), list(UNIT), "left")
    timed = timed.withColumn("est_seconds", F.coalesce("est_seconds", F.lit(DEFAULT_SECONDS)).cast("bigint"))
    order = work_order(chosen.order_by, chosen.order)
    started = within_budget(timed, F.col("est_seconds"), chosen.minutes, order, chosen.pause_seconds)
    return started.withColumnRenamed("position", "priority")


def stored_run(
    spark: SparkSession,
    path: str,
    run_ts: datetime,
    physical: DataFrame,
    operational: DataFrame,
    partitions: DataFrame,
    columns: DataFrame,
    indexes: DataFrame,
    exclusions: DataFrame,
    settings: MaintenanceSettings = MaintenanceSettings(),
    print_only: bool = False,
    **more,
) -> DataFrame:
    """The work of a run that goes on where the last one stopped, by the status kept at ``path``.

    The fleet is scanned if it never was, if every unit is done or with ``force_rescan``.  Units that nothing can be
    done about are marked as done first, so that they do not hold up the next scan.  The queue is stored: it stays as
    it is while ``record_run`` marks its units.  ``more`` are the other arguments of ``maintenance_run``.
    """
    chosen = settings.validated()
    status = current_status(spark, path)
    if status is None or needs_rescan(status, bool(chosen.force_rescan)):
        store_scan(scan_status(physical, operational, partitions, exclusions, chosen), path, run_ts)
        status = current_status(spark, path)
        decided = choose_action(status, partitions, columns, indexes, chosen.rebuild_threshold)
        mark_units(unit_events(decided.where("action = 'SKIP'"), "", SKIPPED, _at(run_ts)), path)
        status = current_status(spark, path)
    queue = maintenance_run(
        physical, operational, partitions, columns, indexes, exclusions,
        as_of=run_ts.date(), settings=chosen, status=status, print_only=print_only, rescanned=True, **more,
    )
    stored = working_path(spark, "queue")
    queue.write.parquet(stored)
    return spark.read.schema(queue.schema).parquet(stored)


def record_run(
    queue: DataFrame,
    path: str,
    run_id: str,
    run_ts: datetime,
    log_path: str | None = None,
    error: Column | None = None,
    seconds: Column | None = None,
    print_only: bool = False,
) -> None:
    """Mark the units of a run at ``path`` and log them at ``log_path``.

    Without ``print_only`` each unit has a start and an end in the log: ``error`` says why its work failed (NULL if it did
    not) and ``seconds`` how long it took.  Repeating the call with the same arguments changes nothing.
    """
    at = _at(run_ts)
    if print_only:
        mark_units(unit_events(queue, run_id, PRINTED, at), path)
        return
    error = F.lit(None).cast("string") if error is None else error
    took = F.lit(0) if seconds is None else seconds
    started = unit_events(queue, run_id, STARTED, at)
    event = F.when(error.isNotNull(), FAILED).otherwise(FINISHED)
    ended = unit_events(queue, run_id, event, at + F.make_dt_interval(secs=took.cast("decimal(18,6)")), error)
    if log_path is not None:
        append_log(started.unionByName(ended), log_path, "event_ts", run_id)
    mark_units(ended, path)


def _at(run_ts: datetime) -> Column:
    return F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz")

