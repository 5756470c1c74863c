"""Executing planned maintenance on partitioned files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgauge.operators.maintenance import FAILED, FINISHED, STARTED
from opsgauge.sources import versioned
from opsgauge.sources.layout import folder_of
from opsgauge.sources.logs import COMPACTION_LOG, append_log

# Rows of one input file that stay together when a partition is split into files.
BLOCK_ROWS = 10_000
# What is rewritten and published at once: the driver holds the names of so many folders.
BATCH_FOLDERS, BATCH_BYTES = 1_000, 1024**4
MAX_TASKS = 20_000


def compact(
    spark: SparkSession,
    units: DataFrame,
    root: str,
    partition_cols: Sequence[str],
    target_bytes: int,
    sort_by: Sequence[str] = (),
    log_path: str | None = None,
    run_id: str = "",
) -> int:
    """Rewrite the planned partitions of a versioned table into files of about ``target_bytes``.

    ``units`` has ``directory``, ``total_bytes`` and optionally ``action`` (SKIP is
    left alone).  Folders are rewritten in batches of bounded size, each published as a version of its
    own after the row counts have been compared.  With ``log_path`` the start and the
    end, or the error, of every unit is logged.  Returns the version that is current afterwards.
    """
    chosen = units.where(F.col("action") != "SKIP") if "action" in units.columns else units
    files = F.greatest(F.ceil(F.col("total_bytes") / F.lit(target_bytes)).cast("int"), F.lit(1))
    for wanted in _batches(chosen.select("directory", files.alias("files"), "total_bytes")):
        log = _logger(spark, wanted, log_path, run_id)
        log(STARTED)
        try:
            _rewrite(spark, wanted, root, partition_cols, sort_by)
        except Exception as error:
            log(FAILED, str(error))
            raise
        log(FINISHED)
    return versioned.current_version(spark, root)


def _batches(units: DataFrame) -> Iterator[list[tuple[str, int]]]:
    """Folders and their numbers of files, in batches."""
    batch, size = [], 0
    for row in units.toLocalIterator():
        if batch and (len(batch) >= BATCH_FOLDERS or size + row.total_bytes > BATCH_BYTES):
            yield batch
            batch, size = [], 0
        batch.append((row.directory, row.files))
        size += row.total_bytes
    if batch:
        yield batch


def _logger(spark: SparkSession, wanted: list[tuple[str, int]], log_path: str | None, run_id: str):
    def log(event: str, error: str | None = None) -> None:
        if log_path is not None:
            now = datetime.now(UTC).replace(tzinfo=None)
            events = [(run_id, directory, event, now, error) for directory, _ in wanted]
            append_log(spark.createDataFrame(events, COMPACTION_LOG), log_path, "event_ts", f"{run_id}-{uuid.uuid4().hex}")

    return log


def _rewrite(
    spark: SparkSession,
    wanted: list[tuple[str, int]],
    root: str,
    partition_cols: Sequence[str],
    sort_by: Sequence[str],
) -> None:
    """Stage, check and publish the new folders of one batch.

    Only the planned folders are read.  A large one is spread over as many tasks as
    it gets files, so no task holds a whole partition.
    """
    version = versioned.current_version(spark, root)
    plan = spark.createDataFrame(wanted, "directory string, _files int")
    rows = versioned.read_current(spark, root, [directory for directory, _ in wanted])
    origin = rows.select(
        "*",
        folder_of(F.col("_metadata.file_path")).alias("directory"),
        F.col("_metadata.file_path").alias("_path"),
        F.floor(F.col("_metadata.row_index") / BLOCK_ROWS).alias("_block"),
    )
    slot = F.pmod(F.xxhash64("_path", "_block"), F.col("_files")).alias("_slot")
    # At most BATCH_FOLDERS rows.
    placed = origin.join(F.broadcast(plan), "directory").select(*rows.columns, slot)
    # More tasks than files, so that two files seldom meet in a task.
    tasks = min(4 * sum(files for _, files in wanted), MAX_TASKS)
    spread = placed.repartition(tasks, *partition_cols, "_slot")
    ordered = spread.sortWithinPartitions(*partition_cols, "_slot", *sort_by).drop("_slot")
    staged = versioned.stage(ordered, root, versioned.staging_name(version + 1), partition_cols)
    versioned.publish_replacement(spark, root, version + 1, staged, plan)
