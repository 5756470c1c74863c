from __future__ import annotations

import random
from collections import defaultdict

import pytest

from opsgauge.llm.mixing import _largest_first, balanced_rates, mixed, repeated, source_targets
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, source string, size int, high string, row int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*row, 1, "x", 2) for row in rows], SCHEMA)


def sample(seed, size=600):
    rng = random.Random(seed)
    names = ["a", "B", "ä", "z", None, "", "tiny", "c"]
    weights = [30, 1, 5, 5, 3, 2, 0.3, 10]
    rows = [(doc, "w " * int(rng.paretovariate(1.2) * 8), rng.choices(names, weights)[0]) for doc in range(size)]
    return rows + [(1000, None, "a"), (1001, "", "empty"), (1002, "  ", "empty")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_equal_repeated_sharing(spark, seed):
    rows = sample(seed)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(brute.words(text))
    found = {row.source: row.target for row in mixed(docs_of(spark, rows)).collect()}
    expected = brute.targets(sizes)
    assert found.keys() == expected.keys()
    for source, target in expected.items():
        assert found[source] == pytest.approx(target, rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_taken_words_meet_the_targets(spark, seed):
    rows = sample(seed)
    found = mixed(docs_of(spark, rows)).collect()
    assert len(found) == len(rows)
    taken, goal, most = defaultdict(int), {}, defaultdict(int)
    for row in found:
        assert row.size == len(brute.words(row.text)) and 0 <= row.copies <= 3
        taken[row.source] += row.copies * row.size
        goal[row.source] = row.target
        most[row.source] = max(most[row.source], row.size)
    for source, target in goal.items():
        assert taken[source] <= target + 1e-6
        assert target - taken[source] < most[source] or not target
    large = max(goal, key=goal.get)
    assert goal[large] - taken[large] < 0.01 * goal[large]


@pytest.mark.parametrize("seed", [1, 6])
def test_no_allowed_copy_fits_in_what_is_missing(spark, seed):
    rows = sample(seed, 300) + [(2000 + at, "w " * 9, "few") for at in range(2)] + [(3000, "w " * 700, "few")]
    found = mixed(docs_of(spark, rows)).collect()
    taken, goal, least = defaultdict(int), {}, {}
    for row in found:
        taken[row.source] += row.copies * row.size
        goal[row.source] = row.target
        if row.size and row.copies < 3:
            least[row.source] = min(least.get(row.source, row.size), row.size)
    for source, target in goal.items():
        assert taken[source] <= target + 1e-6
        assert source not in least or target - taken[source] < least[source]


def test_quotas_by_size():
    pd = pytest.importorskip("pandas")
    cells = pd.DataFrame({"source": ["a"] * 3, "size": [3, 50, 7], "n": [9, 1, 2], "missing": [80.5] * 3})
    assert _largest_first(cells).values.tolist() == [["a", 50, 1], ["a", 7, 2], ["a", 3, 5]]


def test_runs_agree_whatever_the_partitions(spark):
    docs = docs_of(spark, sample(4))
    runs = [sorted(map(str, mixed(docs.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_equal_rows_share_their_copies(spark):
    rows = [(1, "w " * 10, "a")] * 100 + [(2, "v " * 10, "b")] * 100 + [(3, "u " * 10, "c")] * 100
    found = mixed(docs_of(spark, rows)).collect()
    taken = defaultdict(int)
    for row in found:
        taken[row.source] += row.copies * row.size
    # Shares of 3000 words by 5, 2 and 1.
    assert {source: target - target % 10 for source, target in (("a", 1875), ("b", 750), ("c", 375))} == dict(taken)


def test_rates_solve_the_dual(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10**9), ("d", 7), ("e", 0)], "source string, size bigint")
    for row in balanced_rates(source_targets(sizes)).collect():
        assert row.rate * row.source_size == pytest.approx(row.target, rel=1e-9)


def test_repeated_rows_have_the_columns(spark):
    rows = sample(5)
    docs = docs_of(spark, rows)
    out = repeated(docs)
    assert out.columns == docs.columns
    copies = {row.doc_id: row.copies for row in mixed(docs).collect()}
    counts = defaultdict(int)
    for row in out.collect():
        counts[row.doc_id] += 1
    assert counts == {doc: n for doc, n in copies.items() if n}


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    assert mixed(docs).count() == 0 and repeated(docs).count() == 0
    found = mixed(docs_of(spark, [(1, None, None), (1, None, None)])).collect()
    assert [(row.size, row.target, row.copies) for row in found] == [(0, 0.0, 0)] * 2
