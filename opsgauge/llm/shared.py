"""Helpers of the text operators: written intermediate tables, row keys, checked broadcasts."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgauge.session import working_path

# A table is sent whole to every task only if its rows are known to fit in this.
MAX_BROADCAST_BYTES = 32 * 1024**2
ROW_OVERHEAD = 96

# The blanks that separate words: space, tab, newline, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"

# Narrow rows that make a file worth its task.
ROWS_PER_FILE = 100_000

_written: list[str] = []


def written(df: DataFrame, purpose: str, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Fixes its rows and cuts the lineage: a lost executor loses nothing that was written.
    If it is known to have at most ``rows`` narrow rows, it is written in files of some size.
    """
    if rows is not None:
        df = df.coalesce(max(8, rows // ROWS_PER_FILE))
    path = working_path(df.sparkSession, purpose)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in batches of bounded size, however long the texts are.

    Sets the session's limits for Arrow batches; they hold for the queries that follow.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * 1024**2))


def written_paths() -> list[str]:
    """The intermediate tables written so far and not dropped."""
    return list(_written)


def drop_written(spark: SparkSession, paths: list[str], reader: DataFrame | None = None) -> None:
    """Remove intermediate tables, once the results made of them are stored; those that ``reader`` reads are kept."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    needed = reader.inputFiles() if paths and reader is not None else []
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        if path in _written and not any(f"/{name}/" in file for file in needed):
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
            _written.remove(path)


def small(df: DataFrame, row_bytes: int, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit in ``limit``; else joined by shuffle.

    ``row_bytes`` is the size of a row's values; its place in the hash table is added.  ``df`` should
    be written or cheap: it is counted first.
    """
    return F.broadcast(df) if df.count() * (row_bytes + ROW_OVERHEAD) <= limit else df


def text_key(text: Column, *more: Column) -> Column:
    """A 64-bit key of a text (and other columns); NULL counts as a value of its own."""
    return F.xxhash64(text.isNull(), text, *more)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that do not clash with the ``taken`` ones."""
    lower = {name.lower() for name in taken}
    found = []
    for name in names:
        while name.lower() in lower:
            name += "_"
        lower.add(name.lower())
        found.append(name)
    return found


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker it is asked for in."""
    return sys.modules.setdefault("worker_cache", types.ModuleType("worker_cache")).__dict__


def word_array(text: Column) -> Column:
    """The words of a text, parted by runs of blanks; none for NULL and blank texts."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def word_count(text: Column) -> Column:
    """The number of words of a text."""
    return F.size(word_array(text)).cast("bigint")
