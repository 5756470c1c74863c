"""Column profiles and the bytes that declared types waste."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.functions.sizing import UNIT_BYTES, SizedColumn, profilable_columns, required_bytes
from opsgauge.functions.text import literal, quoted

_NUMBERS = ("max", "min", "max_len", "avg_len", "row_count", "declared")
_PROFILE = ("column", "kind", *_NUMBERS[:-1])


def profile_columns(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """One row per integer or character column, all of them from one scan.

    Integers report max and min; strings the longest and the average length
    (whole characters, trailing blanks not counted).
    """
    return _profile(df, profilable_columns(df.schema, cols)).select(*_PROFILE)


def wasted_space(
    df: DataFrame,
    declared_lengths: Mapping[str, int] | None = None,
    percent_growth: int = 10,
    unit: str = "MB",
    compat: bool = False,
    cols: Iterable[str] | None = None,
) -> DataFrame:
    """Declared minus required bytes per column, the space that is over all rows, and a total.

    A negative reduction means the column may outgrow its type: ``at_risk``.
    A column with only NULLs or without a declared width has NULL and does not
    count in the total.
    """
    profile = _profile(df, profilable_columns(df.schema, cols, declared_lengths))
    return with_totals(reductions(profile, percent_growth, compat), ["columnName"], unit)


def wasted_space_all(
    tables: Mapping[str, DataFrame],
    declared_lengths: Mapping[str, Mapping[str, int]] | None = None,
    percent_growth: int = 10,
    unit: str = "MB",
    compat: bool = False,
) -> DataFrame:
    """``wasted_space`` of every table, each read once, with totals per table and overall."""
    profiles = []
    for name, df in tables.items():
        fields = profilable_columns(df.schema, None, (declared_lengths or {}).get(name))
        if fields:
            profiles.append(_profile(df, fields).selectExpr(f"{literal(name)} AS tableName", "*"))
    if not profiles:
        raise ValueError("no table has an integer or character column")
    sized = reductions(_union(profiles), percent_growth, compat)
    return with_totals(sized, ["tableName", "columnName"], unit)


def _union(frames: list[DataFrame]) -> DataFrame:
    """Union in pairs, so that the plan stays shallow for many tables."""
    while len(frames) > 1:
        pairs = [frames[at : at + 2] for at in range(0, len(frames), 2)]
        frames = [pair[0].union(pair[1]) if len(pair) == 2 else pair[0] for pair in pairs]
    return frames[0]


def _profile(df: DataFrame, fields: list[SizedColumn]) -> DataFrame:
    """The profile with declared widths: one aggregate, then one row per column.

    Written as SQL expressions because a table may have thousands of columns and
    each ``Column`` object costs the driver a round trip.
    """
    if not fields:
        raise ValueError("no integer or character column to profile")
    measures, rows = ["count(1) AS rows"], []
    for at, field in enumerate(fields):
        value = quoted(field.name)
        high, low, total, known = (f"{part}_{at}" for part in ("high", "low", "total", "known"))
        if field.is_integer:
            measures += [f"max({value}) AS {high}", f"min({value}) AS {low}"]
            found = (high, low, "NULL", "NULL")
        else:
            length = f"length(rtrim({value}))"
            measures += [f"max({length}) AS {high}", f"sum({length}) AS {total}", f"count({value}) AS {known}"]
            found = ("NULL", "NULL", high, f"{total} div nullif({known}, 0)")
        declared = "NULL" if field.declared is None else field.declared
        numbers = ", ".join(
            f"'{name}', CAST({item} AS BIGINT)"
            for name, item in zip(_NUMBERS, (*found, "rows", declared), strict=True)
        )
        rows.append(f"named_struct('column', {literal(field.name)}, 'kind', '{field.kind}', {numbers})")
    return df.selectExpr(*measures).selectExpr(f"inline(array({', '.join(rows)}))")


def reductions(profile: DataFrame, percent_growth: int, compat: bool) -> DataFrame:
    """Declared minus required bytes of profiled columns."""
    needed = required_bytes(
        F.col("kind") != "string",
        F.col("max"),
        F.col("min"),
        F.col("max_len"),
        percent_growth,
        compat,
    )
    return profile.withColumnRenamed("column", "columnName").withColumn("byteReduction", F.col("declared") - needed)


def with_totals(sized: DataFrame, levels: list[str], unit: str) -> DataFrame:
    """Reductions by column with the space they free, and totals."""
    if unit not in UNIT_BYTES:
        raise ValueError(f"unit must be one of {', '.join(UNIT_BYTES)}")
    detail = F.grouping_id() == 0
    saved = F.sum(F.col("byteReduction").cast("decimal(38,0)") * F.col("row_count"))
    return (
        sized.rollup(*levels)
        .agg(
            detail.alias("_detail"),
            F.max("byteReduction").alias("_reduction"),
            saved.alias("_saved"),
            F.max("avg_len").alias("_length"),
        )
        .select(
            *[F.coalesce(F.col(level), F.lit("Total")).alias(level) for level in levels],
            F.when(F.col("_detail"), F.col("_reduction")).alias("byteReduction"),
            (F.col("_saved").cast("double") / UNIT_BYTES[unit]).alias("estimatedSpaceSavings"),
            F.when(F.col("_detail"), F.col("_length")).alias("avgLength"),
            F.when(F.col("_detail"), F.col("_reduction") < 0).alias("at_risk"),
        )
    )
