from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsgauge.llm.sharding import communication_matrix, hypergeometric, shard_sizes, sharded


def test_sizes_and_slots(spark):
    rows = spark.range(1003).repartition(7).select(F.col("id").alias("doc_id"), F.lit("a").alias("shard"), F.lit(1).alias("part"))
    out = sharded(rows, shards=10, rows_per_part=20)
    assert out.columns == ["doc_id", "part", "shard", "slot"]
    found = out.collect()
    assert sorted(row.doc_id for row in found) == list(range(1003))
    slots = {}
    for row in found:
        slots.setdefault(row.shard, []).append(row.slot)
    assert sorted(len(own) for own in slots.values()) == [100] * 7 + [101] * 3
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_runs_agree_and_seeds_differ(spark):
    rows = spark.range(200).repartition(3)
    one, two, other = (sorted(map(tuple, sharded(rows, 5, seed).collect())) for seed in (1, 1, 2))
    assert one == two != other


def test_nulls_equal_rows_and_few_rows(spark):
    rows = spark.createDataFrame([(None, None)] * 5 + [(1, "x")] * 4, "doc_id bigint, text string")
    found = sharded(rows, shards=24).collect()
    assert len(found) == 9 and all(row.slot == 0 for row in found)
    assert len({row.shard for row in found}) == 9
    assert sharded(rows.limit(0), shards=24).count() == 0


def test_places_are_uniform(spark):
    # Where the first row lands over many seeds.
    rows = spark.range(12).repartition(3)
    landed = Counter()
    for seed in range(40):
        landed.update((row.id, row.shard) for row in sharded(rows, 2, seed).collect())
    counts = np.array([landed[(doc, 0)] for doc in range(12)])
    assert counts.sum() == 40 * 6
    assert abs(counts - 20).max() <= 15


def test_matrix_has_exact_sums_and_the_right_law():
    sizes = shard_sizes(1000, 7)
    matrix = np.array(communication_matrix([10, 0, 490, 500], sizes, seed=3))
    assert matrix.sum(axis=0).tolist() == sizes and matrix.sum(axis=1).tolist() == [10, 0, 490, 500]
    rng = np.random.default_rng(1)
    drawn = np.array([hypergeometric(rng, 30, 70, 20) for _ in range(20_000)])
    exact = np.random.default_rng(2).hypergeometric(30, 70, 20, 20_000)
    for at in range(1, 13):
        assert abs((drawn == at).mean() - (exact == at).mean()) < 0.015
    assert drawn.min() >= 0 and drawn.max() <= 20


@pytest.mark.parametrize(("good", "bad", "drawn", "expected"), [(0, 5, 3, 0), (5, 0, 3, 3), (4, 4, 8, 4), (3, 9, 0, 0)])
def test_edges_of_the_draw(good, bad, drawn, expected):
    assert hypergeometric(np.random.default_rng(0), good, bad, drawn) == expected


def test_draw_from_very_many():
    drawn = hypergeometric(np.random.default_rng(0), 30_000_000_000, 690_000_000_000, 1_000_000)
    assert abs(drawn - 1_000_000 / 24) < 2000
