"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

A uniformly random permutation can be made in three steps: draw how many rows each input
partition sends to each shard (a matrix with fixed row and column sums, whose law is
hypergeometric), permute each partition and cut it at these counts, and permute each
shard after the exchange.  Shard sizes are exact and no step sorts the whole table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgauge.llm.shared import MAX_BROADCAST_BYTES, col, fresh, written

SHARDS = 24
# A shard is permuted in parts of about this many rows, each in a task of its own.
ROWS_PER_PART = 5_000
# Draws are by inversion within so many standard deviations: beyond lies less than 1e-30.
_DEVIATIONS = 12


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that add up to ``rows`` and differ by one at most."""
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows are good, for populations of any size."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    total = good + bad
    share = good / total
    deviation = (drawn * share * (1 - share) * (total - drawn) / max(total - 1, 1)) ** 0.5
    middle = min(max(int((drawn + 1) * (good + 1) / (total + 2)), low), high)
    reach = int(_DEVIATIONS * deviation) + 2 * _DEVIATIONS
    values = np.arange(max(low, middle - reach), min(high, middle + reach) + 1, dtype=np.float64)
    # Ratio of the probability of x + 1 to that of x.
    x = values[:-1]
    steps = np.log(good - x) + np.log(drawn - x) - np.log(x + 1) - np.log(bad - drawn + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return int(values[min(int(np.searchsorted(sums, rng.random() * sums[-1], "right")), len(values) - 1)])


def communication_matrix(partition_rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows from each partition to each shard, as a uniform permutation of all rows would have it."""
    rng = np.random.Generator(np.random.PCG64(seed))
    room, matrix = list(sizes), []
    for rows in partition_rows:
        counts, left, others = [], rows, sum(room)
        for space in room:
            others -= space
            count = hypergeometric(rng, space, others, left)
            counts.append(count)
            left -= count
        room = [space - count for space, count in zip(room, counts, strict=True)]
        matrix.append(counts)
    return matrix


def _random(seed: int, *columns: Column) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


def sharded(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = 0,
    rows_per_part: int = ROWS_PER_PART,
    shard_name: str = "shard",
    slot_name: str = "slot",
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... without gaps in each shard).

    Every assignment of rows to places is equally likely; shard sizes differ by one at most.
    Rows are told apart by their place, not by their content, so NULLs and equal rows need no care.  The
    driver holds one count for each input partition and shard.  Columns with the new
    names are replaced.  No rows: no rows.
    """
    spark = docs.sparkSession
    names = [name for name in docs.columns if name.lower() not in (shard_name.lower(), slot_name.lower())]
    at, row, part, first = fresh(names, "_at", "_row", "_part", "_first")
    # Permute each partition: its rows get numbers in the order of random values.
    local = (
        docs.select(*[col(name) for name in names], F.monotonically_increasing_id().alias(at))
        .sortWithinPartitions(_random(seed, F.col(at)))
        .drop(at)
        .withColumn(row, F.monotonically_increasing_id())
    )
    local = written(local, "permuted")
    block, rank = F.shiftright(F.col(row), 33), F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in local.groupBy(block.alias("block")).agg(F.count("*")).collect())
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], shard_sizes(total, shards), seed)
    rows = [(number, [int(x) for x in np.cumsum(own)]) for (number, _), own in zip(counts, matrix, strict=True)]
    cuts = spark.createDataFrame(rows, "block bigint, cuts array<bigint>")
    if len(rows) * (shards + 4) * 8 <= MAX_BROADCAST_BYTES:
        cuts = F.broadcast(cuts)
    # Exchange: the shard is the number of cuts at or below the row's rank.
    placed = local.join(cuts, block == F.col("block"))
    shard = F.size(F.filter("cuts", lambda cut: cut <= rank))
    parts = max(1, -(-total // (shards * rows_per_part)))
    placed = placed.withColumns({shard_name: shard, part: F.pmod(_random(seed + 1, F.col(row)), F.lit(parts))}).drop("block", "cuts")
    # Permute again: random parts, one after the other, each in a random order.
    key = [shard_name, part]
    before = Window.partitionBy(shard_name).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy(*key).agg(F.count("*").alias("n"))
    firsts = firsts.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    order = Window.partitionBy(*key).orderBy(_random(seed + 2, F.col(row)), row)
    numbered = placed.join(firsts, key).withColumn(slot_name, F.col(first) + F.row_number().over(order) - 1)
    return numbered.select(*[col(name) for name in names], shard_name, slot_name)
