"""Usage within a stated period, from snapshots of counters that restarts set back to zero."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgauge.functions.calendar import moment
from opsgauge.operators import INDEX

COUNTERS = ("user_seeks", "user_scans", "user_lookups", "user_updates")


def usage_between(
    snapshots: DataFrame,
    since: datetime,
    until: datetime,
    keys: Sequence[str] = INDEX,
    counters: Sequence[str] = COUNTERS,
    bucket: str = "1 day",
) -> DataFrame:
    """What was counted after ``since`` and up to ``until``, one row per key, however often counting began anew.

    ``snapshots`` has the keys (``server`` among them), the counters, ``snapshot_ts`` and ``stats_since``, the moment from
    which the server counts.  A counter begins anew with a later ``stats_since``, or where any of the key's counters
    falls.  A key's period begins at its last snapshot up to ``since``; without one at ``since`` if the key
    was counted from zero then (its server began later, or had been seen without it), else with its first snapshot.
    ``stats_since`` of the result is that beginning and ``resets`` how often the key was set back.

    Snapshots are compared inside time buckets first and buckets of a key afterwards, so no task holds all snapshots
    of a key: a bucket holds what is taken in ``bucket``, the second step one row for each bucket.
    """
    at, epoch = F.col("snapshot_ts"), F.col("stats_since")
    start, end = moment(since, snapshots, "snapshot_ts"), moment(until, snapshots, "snapshot_ts")
    before = snapshots.where(at <= start)
    # Fixed-size states: a task combines the snapshots of a key before they are sent.
    baseline = before.groupBy(*keys).agg(
        F.max(at).alias("first_ts"),
        F.max_by(epoch, at).alias("first_epoch"),
        *[F.max_by(name, at).alias(f"first_{name}") for name in counters],
    )
    baseline = baseline.select(
        *keys,
        F.lit(None).cast("timestamp").alias("bucket"),
        F.lit(True).alias("base"),
        "first_ts",
        "first_epoch",
        F.col("first_epoch").alias("last_epoch"),
        *[F.col(f"first_{name}") for name in counters],
        *[F.col(f"first_{name}").alias(f"last_{name}") for name in counters],
        *[F.lit(0).cast("bigint").alias(f"more_{name}") for name in counters],
        F.lit(0).cast("bigint").alias("resets"),
    )

    within = snapshots.where((at > start) & (at <= end)).withColumn("bucket", F.window(at, bucket)["start"].cast("timestamp"))
    order = Window.partitionBy(*keys, "bucket").orderBy("snapshot_ts")
    grown = _increments(within, order, counters, {name: name for name in counters}, "stats_since", "stats_since")
    # The last row of a bucket has its totals: the rows are sorted already, so no task holds a table of all buckets.
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = grown.select(
        *keys,
        "bucket",
        F.lit(False).alias("base"),
        F.first(at).over(so_far).alias("first_ts"),
        F.first(epoch).over(so_far).alias("first_epoch"),
        epoch.alias("last_epoch"),
        *[F.first(name).over(so_far).alias(f"first_{name}") for name in counters],
        *[F.col(name).alias(f"last_{name}") for name in counters],
        *[F.sum(F.coalesce(f"grown_{name}", F.lit(0))).over(so_far).cast("bigint").alias(f"more_{name}") for name in counters],
        F.sum(F.col("reset").cast("bigint")).over(so_far).alias("resets"),
        F.lead(F.lit(True)).over(order).isNull().alias("_ends"),
    )
    pieces = pieces.where("_ends").drop("_ends")

    joined = pieces.unionByName(baseline)
    order = Window.partitionBy(*keys).orderBy(F.desc("base"), F.asc("bucket"))
    lasts = {name: f"first_{name}" for name in counters}
    chained = _increments(joined, order, counters, lasts, "first_epoch", "last_epoch", last="last_")
    # Servers that were seen, by the moment they counted from, before the period.
    seen = before.select("server", F.col("stats_since").alias("first_epoch")).distinct().withColumn("seen", F.lit(True))
    chained = chained.join(seen, ["server", "first_epoch"], "left")
    from_zero = (F.col("first_epoch") > moment(since, snapshots, "stats_since")) | F.coalesce("seen", F.lit(False))
    begins = F.col("prior_epoch").isNull() & ~F.col("base")

    def total(name: str) -> Column:
        gap = F.when(begins, F.when(from_zero, F.col(f"first_{name}"))).otherwise(F.col(f"grown_{name}"))
        return F.sum(F.col(f"more_{name}") + F.coalesce(gap, F.lit(0))).cast("bigint").alias(name)

    known = F.when(F.col("base") | (begins & from_zero), start).when(begins, F.col("first_ts"))
    return chained.groupBy(*keys).agg(
        *[total(name) for name in counters],
        F.min(known).alias("stats_since"),
        F.sum(F.col("resets") + F.col("reset").cast("bigint")).alias("resets"),
    )


def _increments(
    rows: DataFrame, order, counters: Sequence[str], values: dict[str, str], epoch: str, prior: str, last: str = ""
) -> DataFrame:
    """``grown_`` columns, what each value is more than the one before it, and whether counting began anew.

    NULL for the first row: there is none before it.
    """
    before = {name: F.lag(f"{last}{name}").over(order) for name in counters}
    lagged = rows.withColumns({f"prior_{name}": column for name, column in before.items()} | {"prior_epoch": F.lag(prior).over(order)})
    fell = F.lit(False)
    for name in counters:
        fell = fell | (F.col(values[name]) < F.col(f"prior_{name}"))
    reset = F.coalesce((F.col(epoch) > F.col("prior_epoch")) | fell, F.lit(False))
    marked = lagged.withColumn("reset", reset)
    return marked.withColumns(
        {
            f"grown_{name}": F.when(F.col("reset"), F.col(values[name])).otherwise(
                F.col(values[name]) - F.col(f"prior_{name}")
            )
            for name in counters
        }
    )
