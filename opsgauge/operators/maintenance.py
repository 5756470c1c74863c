"""Maintenance planning over work units.

A work unit is one partition of one index, or one partition of a dataset laid
out in files.  Size may be pages, bytes or files and fragmentation may be the
share of small files; the operators only compare them.  ``keys`` names the
columns that identify a unit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgauge.functions.calendar import moment, weekday_bit
from opsgauge.functions.statements import REBUILD_OPTIONS, maintenance_command
from opsgauge.functions.text import quote_name
from opsgauge.operators import INDEX, OBJECT, SCOPE, UNIT
from opsgauge.plans.ordering import ranked

ORDER_COLUMNS = ("range_scan_count", "fragmentation", "page_count")

# Column types that hold large objects, besides unlimited widths (-1).
LOB_TYPE_IDS = (34, 35, 99)


@dataclass(frozen=True)
class MaintenanceSettings:
    """Planner settings; ``validated`` puts unusable ones back to their defaults."""

    min_fragmentation: float | None = 10.0
    rebuild_threshold: float | None = 30.0
    order_by: str | None = "range_scan_count"
    order: str | None = "DESC"
    min_size: int | None = 8
    max_size: int | None = None
    minutes: int | None = 720
    pause_seconds: int | None = 5
    exclude_latest: bool = False
    force_rescan: bool | None = False

    def validated(self) -> MaintenanceSettings:
        default = MaintenanceSettings()
        changes = {}
        for name in ("min_fragmentation", "rebuild_threshold"):
            value = getattr(self, name)
            if value is None or not 0 <= value <= 100:
                changes[name] = getattr(default, name)
        if self.order_by not in ORDER_COLUMNS:
            changes["order_by"] = default.order_by
        if self.order is None or self.order.upper() not in ("ASC", "DESC"):
            changes["order"] = default.order
        if self.min_size is None:
            changes["min_size"] = default.min_size
        if self.pause_seconds is None or not 0 <= self.pause_seconds < 3600:
            changes["pause_seconds"] = default.pause_seconds
        if self.force_rescan is None:
            changes["force_rescan"] = default.force_rescan
        return replace(self, **changes)


def scan_candidates(
    physical: DataFrame,
    operational: DataFrame,
    min_fragmentation: float = 10.0,
    min_size: int = 8,
    keys: Sequence[str] = UNIT,
) -> DataFrame:
    """Units fragmented and large enough: leaf level only, heaps left out."""
    fragmented = physical.where(
        (F.col("avg_fragmentation_in_percent") >= min_fragmentation)
        & (F.col("page_count") > min_size)
        & (F.col("index_level") == 0)
        & (F.col("index_id") > 0)
    )
    return (
        fragmented.join(operational.select(*keys, "range_scan_count"), list(keys))
        .groupBy(*keys, "range_scan_count")
        .agg(
            F.sum("avg_fragmentation_in_percent").alias("fragmentation"),
            F.sum("page_count").alias("page_count"),
        )
    )


def exclude_latest_partition(
    candidates: DataFrame,
    partitions: DataFrame,
    keys: Sequence[str] = INDEX,
    partition: str = "partition_number",
) -> DataFrame:
    """Leave out the right-most partition that has rows, where there is more than the first."""
    latest = (
        partitions.where((F.col(partition) > 1) & (F.col("rows") > 0))
        .groupBy(*keys)
        .agg(F.max(partition).alias(partition))
    )
    return candidates.join(latest, [*keys, partition], "left_anti")


def apply_exclusion_mask(
    candidates: DataFrame, exclusions: DataFrame, keys: Sequence[str] = INDEX
) -> DataFrame:
    """Add the weekdays on which a unit must rest, 0 for none."""
    masks = exclusions.groupBy(*keys).agg(F.bit_or("exclusionMask").alias("exclusionMask"))
    return candidates.join(masks, list(keys), "left").withColumn(
        "exclusionMask", F.coalesce("exclusionMask", F.lit(0))
    )


def eligible_on(candidates: DataFrame, as_of: date) -> DataFrame:
    """Units that may be maintained on this day."""
    return candidates.where(F.col("exclusionMask").bitwiseAND(weekday_bit(as_of)) == 0)


def pending(
    status: DataFrame, min_size: int = 8, max_size: int | None = None, print_only: bool = False
) -> DataFrame:
    """Units not yet done (nor, when only printing, printed) with a size in range."""
    waiting = status.where(F.col("defragDate").isNull() & (F.col("page_count") >= min_size))
    if max_size is not None:
        waiting = waiting.where(F.col("page_count") <= max_size)
    return waiting.where(~F.col("printStatus")) if print_only else waiting


def needs_rescan(status: DataFrame, force: bool = False) -> bool:
    """Whether nothing is left to do, so that the fleet should be scanned again."""
    return force or status.where(F.col("defragDate").isNull()).isEmpty()


def prioritize(
    candidates: DataFrame,
    by: str = "range_scan_count",
    order: str = "DESC",
    keys: Sequence[str] = UNIT,
) -> DataFrame:
    """Number the units in work order."""
    return ranked(candidates, work_order(by, order, keys), rank="priority")


def within_budget(
    queue: DataFrame,
    est_seconds: Column,
    minutes: float | None = 720,
    order: Sequence[Column] = (),
    pause_seconds: int = 0,
    per: Sequence[str] = (),
) -> DataFrame:
    """The units that start before the budget is used up; the last may overrun.

    ``order`` is the work order (default: ``priority``).  ``per`` gives each
    server or database a budget of its own.
    """
    cost = est_seconds.cast("bigint") + F.lit(pause_seconds).cast("bigint")
    started = ranked(
        queue, list(order) or [F.col("priority")], per, "position", {"seconds_before": cost}
    )
    if minutes is None:
        return started
    return started.where(F.col("seconds_before") < round(minutes * 60))


def choose_action(
    candidates: DataFrame,
    partitions: DataFrame,
    columns: DataFrame,
    indexes: DataFrame,
    rebuild_threshold: float = 30.0,
) -> DataFrame:
    """Decide between REORGANIZE, REBUILD and SKIP.

    Light fragmentation, large objects or several partitions call for a
    reorganisation, which needs page locks; the others, and indexes without
    page locks, are rebuilt, which large objects and partitions rule out.
    """
    flags = index_flags(partitions, columns, indexes)
    flagged = candidates.join(flags, list(INDEX), "left").withColumns(
        {
            "partition_count": F.coalesce("partition_count", F.lit(0).cast("bigint")),
            "has_lob": F.coalesce("has_lob", F.lit(False)),
            "page_locks_off": F.coalesce("page_locks_off", F.lit(False)),
        }
    )
    return flagged.withColumn("action", action_for(rebuild_threshold))


def index_flags(partitions: DataFrame, columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """What decides about an index, one row each: partitions, page locks, large objects.

    Put together before the units are joined, so that they are shuffled once and an
    index with very many units meets one row only.
    """
    counts = partitions.groupBy(*INDEX).agg(F.count(F.lit(1)).alias("partition_count"))
    locks = indexes.groupBy(*INDEX).agg(F.max(~F.col("allow_page_locks")).alias("page_locks_off"))
    is_lob = F.col("system_type_id").isin(*LOB_TYPE_IDS) | (F.col("max_length") == -1)
    lobs = columns.where(is_lob).select(*OBJECT).distinct().withColumn("has_lob", F.lit(True))
    return counts.join(locks, list(INDEX), "full_outer").join(lobs, list(OBJECT), "left")


def action_for(rebuild_threshold: float) -> Column:
    """The action from ``fragmentation``, ``has_lob``, ``partition_count`` and ``page_locks_off``."""
    whole = ~F.col("has_lob") & (F.col("partition_count") <= 1)
    heavy = F.col("fragmentation") >= rebuild_threshold
    locked_out = F.col("page_locks_off")
    return (
        F.when(~locked_out & ~(heavy & whole), "REORGANIZE")
        .when(whole & (heavy | locked_out), "REBUILD")
        .otherwise("SKIP")
    )


def resolve_names(
    candidates: DataFrame, objects: DataFrame, indexes: DataFrame, schemas: DataFrame, databases: DataFrame
) -> DataFrame:
    """Add bracketed database, schema, table and index names."""
    owned = objects.select(*OBJECT, "schema_id", F.col("name").alias("_object"))
    owners = schemas.select(*SCOPE, "schema_id", F.col("name").alias("_schema"))
    named_objects = owned.join(owners, [*SCOPE, "schema_id"]).drop("schema_id")
    named_indexes = indexes.where(F.col("type") > 0).select(*INDEX, F.col("name").alias("_index"))
    named_databases = databases.select(*SCOPE, F.col("name").alias("_database"))
    # Databases go into the names first: the units are never joined on their database alone.
    names = named_indexes.join(named_objects, list(OBJECT)).join(named_databases, list(SCOPE), "left")
    return (
        candidates.join(names, list(INDEX), "left")
        .withColumns(
            {
                "databaseName": quote_name(F.col("_database")),
                "schemaName": quote_name(F.col("_schema")),
                "objectName": quote_name(F.col("_object")),
                "indexName": quote_name(F.col("_index")),
            }
        )
        .drop("_database", "_schema", "_object", "_index")
    )


def render_commands(planned: DataFrame, rebuild_options: str = REBUILD_OPTIONS) -> DataFrame:
    """Add the command of each planned unit, NULL for a skipped one."""
    command = maintenance_command(
        F.col("action"),
        F.col("databaseName"),
        F.col("schemaName"),
        F.col("objectName"),
        F.col("indexName"),
        F.col("partition_number"),
        F.col("partition_count"),
        rebuild_options,
    )
    return planned.withColumn("sql_statement", command)


# What an event may say.  The last two are not logged: a command was only printed, or there is none.
STARTED, FINISHED, FAILED = "started", "finished", "failed"
PRINTED, SKIPPED = "printed", "skipped"
LOG_DETAILS = ("databaseName", "objectName", "indexName", "fragmentation", "page_count", "sql_statement")


def maintenance_state(log: DataFrame, keys: Sequence[str] = ("run_id", *UNIT)) -> DataFrame:
    """Current state of every unit in an append-only log of events.

    The latest attempt counts: its duration is in whole seconds, -1 when it
    failed and NULL while it runs.  A unit of which only unknown events are logged has no status.
    """
    happened = F.col("event_ts")
    # A tie in time is won by the end of the attempt.
    code = F.when(F.col("event") == STARTED, 0).when(F.col("event") == FINISHED, 1).when(F.col("event") == FAILED, 2)
    place = F.unix_micros(happened.cast("timestamp")) * 2 + (code > 0).cast("bigint")
    # Fixed-size states only, so each task combines its events in a hash table.
    # Texts would force a sort of the whole log; only failed events carry one.
    state = log.groupBy(*keys).agg(
        F.max(F.when(F.col("event") == STARTED, happened)).alias("dateTimeStart"),
        F.max(F.when(F.col("event").isin(FINISHED, FAILED), happened)).alias("_end"),
        F.max_by(code, place).alias("_code"),
    )
    errors = (
        log.where(F.col("event") == FAILED).groupBy(*keys).agg(F.max_by("error_message", place).alias("_error"))
    )
    code, end = F.col("_code"), F.when(F.col("_code") > 0, F.col("_end"))
    seconds = F.when(code == 2, F.lit(-1).cast("bigint")).otherwise(whole_seconds(F.col("dateTimeStart"), end))
    return state.join(errors, list(keys), "left").select(
        *keys,
        F.when(code == 0, "RUNNING").when(code == 1, "DONE").when(code == 2, "FAILED").alias("status"),
        "dateTimeStart",
        end.alias("dateTimeEnd"),
        seconds.alias("durationSeconds"),
        F.when(code == 2, F.col("_error")).alias("errorMessage"),
    )


def maintenance_summary(
    log: DataFrame, since: datetime, keys: Sequence[str] = ("run_id", *UNIT), include_failed: bool = True
) -> DataFrame:
    """Units worked on and ended since a moment, in the order they ended.

    What the log says about a unit when its work started (``LOG_DETAILS``) is added.
    """
    ended = maintenance_state(log, keys).where(F.col("dateTimeEnd") >= moment(since, log, "event_ts"))
    if not include_failed:
        ended = ended.where(F.col("status") == "DONE")
    details = [name for name in LOG_DETAILS if name in log.columns]
    if details:
        # Of several attempts the latest one; only ended units are looked up.
        started = log.where(F.col("event") == STARTED).join(ended.select(*keys), list(keys), "left_semi")
        latest = started.groupBy(*keys).agg(F.max_by(F.struct(*details), "event_ts").alias("_details"))
        ended = ended.join(latest, list(keys), "left").select(*ended.columns, *[F.col("_details")[d].alias(d) for d in details])
    return ended.orderBy("dateTimeEnd", *keys)


def unit_events(
    units: DataFrame, run_id: str, event: str | Column, at: Column, error: Column | None = None
) -> DataFrame:
    """One event for each unit of a run, as a row of the log; what is known of a unit goes with its start."""
    known = F.lit(event) == STARTED if isinstance(event, str) else event == STARTED
    details = [
        F.when(known, F.col(name)).alias(name) if name in units.columns else F.lit(None).alias(name)
        for name in LOG_DETAILS
    ]
    return units.select(
        F.lit(run_id).alias("run_id"),
        *UNIT,
        (F.lit(event) if isinstance(event, str) else event).alias("event"),
        at.cast("timestamp_ntz").alias("event_ts"),
        (F.lit(None) if error is None else error).cast("string").alias("error_message"),
        *details,
    )


def to_retry(log: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    """Units whose latest attempt failed."""
    return maintenance_state(log, keys).where(F.col("status") == "FAILED").select(*keys, "errorMessage")


def estimates(log: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    """Seconds the latest finished attempt of each unit took, for ``within_budget``."""
    done = maintenance_state(log, keys).where(F.col("status") == "DONE")
    return done.select(*keys, F.col("durationSeconds").alias("est_seconds"))


def whole_seconds(start: Column, end: Column) -> Column:
    """Second boundaries crossed between two timestamps."""
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def work_order(by: str, order: str, keys: Sequence[str] = UNIT) -> list[Column]:
    """Sort columns of the work queue; ties go by key."""
    if by not in ORDER_COLUMNS:
        raise ValueError(f"order by one of {', '.join(ORDER_COLUMNS)}")
    if order.upper() not in ("ASC", "DESC"):
        raise ValueError("order must be ASC or DESC")
    first = F.asc(by) if order.upper() == "ASC" else F.desc(by)
    return [first, *[F.asc(key) for key in keys]]
