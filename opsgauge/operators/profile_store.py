"""Profiles of growing tables: a state for each part of a table, kept and merged.

A part is a value of a column the table is laid out by, such as a day.  Its state has one row for each
profiled column, so a grown table costs a scan of its new parts and a merge of small rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgauge.functions.sizing import SizedColumn, profilable_columns
from opsgauge.functions.text import literal, quoted
from opsgauge.operators.profiling import reductions, with_totals

# What is kept of a column: everything here is merged by max, min or sum.
STATE = (
    "column string, kind string, max bigint, min bigint, max_len bigint, total_len bigint, known bigint, "
    "row_count bigint, declared bigint"
)
_STORED = f"{STATE}, part string"
_NUMBERS = ("max", "min", "max_len", "total_len", "known", "row_count", "declared")


def profile_states(
    df: DataFrame,
    part: str,
    cols: Iterable[str] | None = None,
    declared_lengths: Mapping[str, int] | None = None,
) -> DataFrame:
    """``STATE`` and ``part`` (as text): one row for each part and integer or character column, from one scan.

    The column of the parts is profiled only if ``cols`` names it.  A NULL part is one of its own.
    """
    listed = [name for name in df.columns if name != part] if cols is None else cols
    fields = profilable_columns(df.schema, listed, declared_lengths)
    if not fields:
        raise ValueError("no integer or character column to profile")
    measures = [measure for at, field in enumerate(fields) for measure in _measures(at, field)]
    grouped = df.groupBy(F.expr(f"CAST({quoted(part)} AS STRING)").alias("_part")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.expr(measure) for measure in measures]
    )
    states = ", ".join(_state(at, field) for at, field in enumerate(fields))
    return grouped.selectExpr("_part AS part", f"inline(array({states}))")


def _measures(at: int, field: SizedColumn) -> list[str]:
    value = quoted(field.name)
    if field.is_integer:
        return [f"max({value}) AS _high{at}", f"min({value}) AS _low{at}"]
    length = f"length(rtrim({value}))"
    return [f"max({length}) AS _high{at}", f"sum({length}) AS _total{at}", f"count({value}) AS _known{at}"]


def _state(at: int, field: SizedColumn) -> str:
    declared = "NULL" if field.declared is None else field.declared
    if field.is_integer:
        found = (f"_high{at}", f"_low{at}", "NULL", "NULL", "NULL", "_rows", declared)
    else:
        found = ("NULL", "NULL", f"_high{at}", f"_total{at}", f"_known{at}", "_rows", declared)
    numbers = ", ".join(f"'{name}', CAST({item} AS BIGINT)" for name, item in zip(_NUMBERS, found, strict=True))
    return f"named_struct('column', {literal(field.name)}, 'kind', '{field.kind}', {numbers})"


def new_parts(df: DataFrame, path: str, part: str) -> DataFrame:
    """The rows of ``df`` whose part has no state at ``path``.

    The values of ``part`` pass the driver: it should be what the table is partitioned by, and then
    listing them reads no column and the files of known parts are not opened.
    """
    found = df.select(F.col(quoted(part)).alias("value")).distinct()
    found = found.select("value", F.col("value").cast("string").alias("part")).collect()
    known = {row.part for row in stored_states(df.sparkSession, path).select("part").distinct().collect()}
    missing = [row.value for row in found if row.part not in known]
    chosen = F.col(quoted(part)).isin([value for value in missing if value is not None])
    if None in missing:
        chosen = chosen | F.col(quoted(part)).isNull()
    return df.where(chosen)


def update_profile(
    df: DataFrame,
    path: str,
    part: str,
    cols: Iterable[str] | None = None,
    declared_lengths: Mapping[str, int] | None = None,
    again: DataFrame | None = None,
) -> None:
    """Add the states of the parts of ``df`` that are not at ``path`` yet; of known parts nothing is read.

    ``again``, rows of ``df`` chosen by whole parts, is profiled instead: parts whose rows have changed.  A part has a
    folder of its own which is replaced when its state is complete, so an update can be repeated.
    """
    rows = new_parts(df, path, part) if again is None else again
    (
        profile_states(rows, part, cols, declared_lengths)
        .repartition("part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part")
        .parquet(path)
    )


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    """The states at ``path``; none if nothing was profiled yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).parquet(path)


def merged_profile(states: DataFrame) -> DataFrame:
    """What ``profile_columns`` returns for the whole table, from the states of its parts."""
    return _merged(states).drop("declared")


def merged_wasted_space(
    states: DataFrame, percent_growth: int = 10, unit: str = "MB", compat: bool = False
) -> DataFrame:
    """What ``wasted_space`` returns for the whole table, from the states of its parts.

    Of declared widths that differ between parts the widest counts.
    """
    return with_totals(reductions(_merged(states), percent_growth, compat), ["columnName"], unit)


def _merged(states: DataFrame) -> DataFrame:
    return states.groupBy("column", "kind").agg(
        F.max("max").alias("max"),
        F.min("min").alias("min"),
        F.max("max_len").alias("max_len"),
        F.expr("sum(total_len) div nullif(sum(known), 0)").alias("avg_len"),
        F.sum("row_count").alias("row_count"),
        F.max("declared").alias("declared"),
    )
