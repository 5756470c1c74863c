"""File layout statistics of a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_NAMES = "*.parquet"


def data_files(spark: SparkSession, paths: str | Sequence[str], base_path: str | None = None) -> DataFrame:
    """One row per data file: directory, size and partition columns.

    The files are listed, not opened: ``content`` is pruned away.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", FILE_NAMES)
    if base_path is not None:
        reader = reader.option("basePath", base_path)
    files = reader.load(paths if isinstance(paths, str) else list(paths))
    directory = F.regexp_replace("path", "/[^/]*$", "").alias("directory")
    partitions = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select(directory, "path", "length", *partitions)


def decoded(text: Column) -> Column:
    """URL-encoded text, where a plus sign is just one."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def folder_of(file_url: Column) -> Column:
    """The ``directory`` of a file from ``_metadata.file_path``, which is URL-encoded."""
    return F.regexp_replace(decoded(file_url), "/[^/]*$", "")


def layout_stats(files: DataFrame, small_bytes: int, partition_cols: Sequence[str] = ()) -> DataFrame:
    """Files, bytes and share of small files per partition, as the planner's input.

    ``page_count`` is the number of files; a partition of one file has nothing
    to merge, so its fragmentation is 0 whatever its size.
    """
    small = F.count_if(F.col("length") < small_bytes)
    count = F.count(F.lit(1))
    return files.groupBy("directory", *partition_cols).agg(
        count.alias("page_count"),
        F.sum("length").alias("total_bytes"),
        F.when(count > 1, small * 100.0 / count).otherwise(0.0).cast("double").alias("fragmentation"),
    )


def remove_folders(spark: SparkSession, folders: DataFrame) -> int:
    """Delete the distinct folders named in ``directory``; returns how many.

    Only names pass the driver, one per partition folder.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    removed = 0
    for row in folders.select("directory").distinct().toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(row.directory)
        removed += folder.getFileSystem(conf).delete(folder, True)
    return removed
