"""Stored tables as streams: in the order of their time, a bounded part of all of them in each batch.

The state of a stream then holds what its lateness keeps open and one batch, however large the tables are.
"""

from __future__ import annotations

import math
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PERIOD = "_period"
# Cuts are chosen among so many shares of the rows.
_SHARES = 1000
# Tasks split a file between its row groups.
_ROW_GROUP_BYTES = 4 * 1024**2


def replay(
    session: SparkSession, tables: Mapping[str, tuple[DataFrame, str]], path: str, rows_per_batch: int
) -> dict[str, DataFrame]:
    """Each table as a stream of ``session``, written below ``path`` in periods that all tables share.

    ``tables`` has a DataFrame and its time column (``timestamp``) by name.  A period holds about ``rows_per_batch`` rows
    of the first one.  It is one file of each table, and files are older the earlier their period is, so a batch reads
    the same period of all.  Where the file system does not keep the times that files are given, one batch
    reads everything: what comes out of order would be late.  Rows without a time belong to no period and are left out.
    """
    cuts = _cuts(*next(iter(tables.values())), rows_per_batch)
    ordered = True
    for name, (rows, at) in tables.items():
        _write(rows, at, cuts, f"{path}/{name}")
        ordered = _dated(session, f"{path}/{name}", len(cuts) + 1) and ordered
    streams = {}
    for name, (rows, at) in tables.items():
        reader = session.readStream.schema(f"{rows.schema.toDDL()}, {_PERIOD} int")
        if ordered:
            reader = reader.option("maxFilesPerTrigger", 1)
        streams[name] = reader.parquet(f"{path}/{name}").where(F.col(at).isNotNull()).drop(_PERIOD)
    return streams


def _cuts(rows: DataFrame, at: str, rows_per_batch: int) -> list[int]:
    """The first moment of each period but the first, in microseconds."""
    shares = [number / _SHARES for number in range(1, _SHARES)]
    moment = F.unix_micros(F.col(at))
    found = rows.agg(F.count(moment).alias("rows"), F.percentile_approx(moment, shares).alias("at")).first()
    periods = min(_SHARES, math.ceil(found["rows"] / rows_per_batch))
    return sorted({found["at"][_SHARES * number // periods - 1] for number in range(1, periods)})


def _write(rows: DataFrame, at: str, cuts: list[int], path: str) -> None:
    passed = [(F.unix_micros(F.col(at)) >= cut).cast("int") for cut in cuts]
    dated = rows.where(F.col(at).isNotNull()).withColumn(_PERIOD, sum(passed, F.lit(0)))
    # A row without a time in each period: its file is there also if nothing happened.
    periods = rows.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias(_PERIOD))
    (
        dated.unionByName(periods, allowMissingColumns=True)
        .repartition(len(cuts) + 1, _PERIOD)
        .write.option("parquet.block.size", _ROW_GROUP_BYTES)
        .partitionBy(_PERIOD)
        .parquet(path)
    )


def _dated(spark: SparkSession, path: str, periods: int) -> bool:
    """Give the file of each period a time of its own; whether all have one file and kept its time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    begin = (int(time.time()) - periods) * 1000
    for number in range(periods):
        pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/{_PERIOD}={number}/*.parquet")
        system = pattern.getFileSystem(conf)
        files = system.globStatus(pattern)
        if len(files) != 1:
            return False
        file, at = files[0].getPath(), begin + number * 1000
        system.setTimes(file, at, -1)
        if system.getFileStatus(file).getModificationTime() != at:
            return False
    return True
