"""The maintenance planner over the folders of a partitioned dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.operators.maintenance import (
    MaintenanceSettings,
    prioritize,
    scan_candidates,
    within_budget,
    work_order,
)
from opsgauge.sources.layout import layout_stats

UNIT = ("directory",)


def compaction_plan(
    files: DataFrame,
    small_bytes: int,
    partition_cols: Sequence[str],
    settings: MaintenanceSettings = MaintenanceSettings(min_size=1, order_by="page_count"),
    reads: DataFrame | None = None,
    latest_by: str | None = None,
    bytes_per_second: int | None = None,
) -> DataFrame:
    """The folders worth compacting, numbered in work order.

    ``files`` has one row per data file.  Fragmentation is the percentage of
    small files, size the number of files.  ``reads`` may bring ``directory`` and
    ``range_scan_count`` for ordering by use.  ``latest_by`` names the partition
    column whose highest value is still being written and is left out.  With
    ``bytes_per_second`` only what starts within the time budget is planned.
    """
    chosen = settings.validated()
    stats = layout_stats(files, small_bytes, partition_cols)
    physical = stats.withColumns(
        {
            "avg_fragmentation_in_percent": F.col("fragmentation"),
            # Files have no levels and no heap; these pass the planner's tests.
            "index_level": F.lit(0),
            "index_id": F.lit(1),
        }
    )
    if reads is None:
        reads = stats.select(*UNIT, F.lit(0).cast("bigint").alias("range_scan_count"))
    candidates = scan_candidates(physical, reads, chosen.min_fragmentation, chosen.min_size, UNIT)
    if chosen.max_size is not None:
        candidates = candidates.where(F.col("page_count") <= chosen.max_size)
    described = candidates.join(stats.select(*UNIT, *partition_cols, "total_bytes"), list(UNIT))
    if latest_by is not None:
        latest = stats.agg(F.max(latest_by).alias(latest_by), F.min(latest_by).alias("_first"))
        latest = latest.where(F.col(latest_by) > F.col("_first")).select(latest_by)
        described = described.join(latest, latest_by, "left_anti")
    decided = described.withColumn("action", F.lit("REBUILD"))
    if bytes_per_second is None:
        return prioritize(decided, chosen.order_by, chosen.order, UNIT)
    # One ranking gives both the place in the queue and the time before it.
    seconds = F.ceil(F.col("total_bytes") / bytes_per_second)
    order = work_order(chosen.order_by, chosen.order, UNIT)
    started = within_budget(decided, seconds, chosen.minutes, order, chosen.pause_seconds)
    return started.withColumnRenamed("position", "priority")
