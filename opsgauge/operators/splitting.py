"""Delimited strings as rows, and filters given as a comma list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgauge.functions.text import column, is_empty, parse_list, split_all

# A longer list is joined instead of written into the filter.
MAX_FILTER_VALUES = 1000


def split_rows(
    df: DataFrame,
    col: str,
    delimiter: str,
    keep: Sequence[str] = (),
    with_pos: bool = False,
) -> DataFrame:
    """One row per element that is not blank; ``keep`` names the columns carried along.

    Only those columns and the string are read.  ``pos`` counts kept elements from 1.
    """
    kept = [column(name) for name in keep]
    if not with_pos:
        # Filtering the rows stays in generated code; filtering the array would not.
        rows = df.select(*kept, F.explode(split_all(column(col), delimiter)).alias("stringValue"))
        return rows.where(~is_empty(F.col("stringValue")))
    parts = F.filter(split_all(column(col), delimiter), lambda part: ~is_empty(part))
    return df.select(*kept, F.posexplode(parts).alias("pos", "stringValue")).withColumn(
        "pos", F.col("pos") + 1
    )


def register_split_functions(spark: SparkSession) -> None:
    """Make the splitting available to SQL.

    ``SELECT * FROM split_rows('a,b', ',')`` gives the elements of a parameter as
    rows.  A table's column is better served by ``split_kept(col, ',')``, an array
    to explode: Spark turns a table function over a column into a join.
    """
    parts = r"split(trim(value), concat('\\Q', replace(delimiter, '\\E', '\\E\\\\E\\Q'), '\\E'), -1)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION split_kept(value STRING, delimiter STRING) RETURNS ARRAY<STRING> "
        f"RETURN filter({parts}, part -> length(trim(part)) > 0)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION split_rows(value STRING, delimiter STRING) "
        "RETURNS TABLE (stringValue STRING) "
        f"RETURN SELECT part FROM (SELECT explode({parts}) AS part) WHERE length(trim(part)) > 0"
    )


def filter_by_list(df: DataFrame, col: str, names: str | None) -> DataFrame:
    """Rows whose column is in a comma list; None keeps everything."""
    if names is None:
        return df
    values = sorted(set(parse_list(names)))
    if len(values) <= MAX_FILTER_VALUES:
        return df.where(column(col).isin(*values)) if values else df.where(F.lit(False))
    spark = df.sparkSession
    wanted = spark.createDataFrame([(value,) for value in values], "_wanted string")
    return df.join(wanted, column(col) == F.col("_wanted"), "left_semi")
