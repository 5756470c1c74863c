"""Ranks and running totals over groups of any size.

A window function puts each group in one task, so a group that holds a third
of a large table (or a ranking without groups) would not survive.  Here the
rows are sorted across the cluster once and written to the checkpoint folder,
which fixes both their order and their partitions.  A row's place is then its
place inside its sorted partition plus a small per-partition carry-over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgauge.functions.text import column
from opsgauge.session import checkpointed

# Size of a carry-over that is sent to every task; a larger one is joined by shuffle.
MAX_BROADCAST_BYTES = 64 * 1024**2

_ROW, _PART, _FIRST, _BEFORE = "_row", "_part", "_first", "_before"


def ranked(
    df: DataFrame,
    order: Sequence[Column],
    groups: Sequence[str] = (),
    rank: str = "rank",
    totals_before: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ``rank`` (1, 2, ...) within each group, and totals of the rows before.

    ``order`` must be total within a group, or ranks of equal rows are arbitrary.
    ``totals_before`` maps a new column to the exact numeric expression summed
    over the earlier rows of the group (0 for the first one).
    """
    totals = dict(totals_before or {})
    group_cols = [column(name) for name in groups]
    prepared = df.select("*", *[value.alias(f"_value_{name}") for name, value in totals.items()])
    placed = (
        checkpointed(prepared.orderBy(*group_cols, *order))
        .withColumn(_ROW, F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftrightunsigned(_ROW, 33))
    )

    # One row per sorted partition and group met in it.
    pieces = placed.groupBy(_PART, *groups).agg(
        F.min(_ROW).alias(_FIRST),
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_value_{name}").alias(f"_sum_{name}") for name in totals],
    )
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(_PART)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        _PART,
        *group_cols,
        _FIRST,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias(_BEFORE),
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_carry_{name}")
            for name in totals
        ],
    )

    if totals:
        piece = Window.partitionBy(_PART, *groups).orderBy(_ROW)
        piece = piece.rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumns(
            {f"_inner_{name}": F.coalesce(F.sum(f"_value_{name}").over(piece), F.lit(0)) for name in totals}
        )

    # Many groups make this a table of its own; it is measured and joined, so computed once.
    carried = checkpointed(carried)
    if _stored_bytes(carried, groups) <= MAX_BROADCAST_BYTES:
        # Few groups, or none: saves the shuffle of all rows.
        carried = F.broadcast(carried)
    joined = _null_safe_join(placed, carried, [_PART, *groups])
    return joined.select(
        *[column(name) for name in df.columns],
        (F.col(_ROW) - F.col(_FIRST) + F.col(_BEFORE) + 1).alias(rank),
        *[(F.col(f"_carry_{name}") + F.col(f"_inner_{name}")).alias(name) for name in totals],
    )


def top_in_groups(
    df: DataFrame, order: Sequence[Column], groups: Sequence[str], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group.

    The rank filter lets each task keep only its own best ``k`` rows per group
    before the shuffle, so a hot group stays small.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).where(F.col(rank) <= k)


def _stored_bytes(carried: DataFrame, groups: Sequence[str]) -> int:
    """Size of the carry-over: a row per sorted partition and group met in it."""
    row_size = F.lit(100)
    for name in groups:
        row_size = row_size + F.coalesce(F.octet_length(column(name).cast("string")), F.lit(0))
    return carried.agg(F.sum(row_size)).first()[0] or 0


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(*[column(c).alias(f"_k_{c}" if c in keys else c) for c in right.columns])
    on = [column(key).eqNullSafe(column(f"_k_{key}")) for key in keys]
    condition = on[0]
    for part in on[1:]:
        condition = condition & part
    return left.join(renamed, condition).drop(*[f"_k_{key}" for key in keys])
