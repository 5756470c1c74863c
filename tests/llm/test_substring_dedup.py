from __future__ import annotations

import random

import pytest

from opsgauge.llm.substring_dedup import remove_repeats
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, doc string, n_words string"


def docs_of(spark, rows):
    return spark.createDataFrame([(doc, text, "extra", "old") for doc, text in rows], SCHEMA)


def passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{at}" for at in range(400)] + ["the", "of"] * 60
    shared = [rng.choices(vocabulary, k=rng.randint(18, 60)) for _ in range(6)]
    rows = []
    for doc in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                parts += rng.choice(shared)[rng.randint(0, 5) :]
            else:
                parts += rng.choices(vocabulary, k=rng.randint(1, 40))
        rows.append((doc * 3 % 61, rng.choice([" ", "\n", "  ", "\t"]).join(parts)))
    rows += [(100, "same " * 70), (101, "same " * 45), (102, None), (103, ""), (104, "ein Wörtchen   mehr")]
    return rows + [(200, rows[3][1]), (201, rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = passages(seed)
    found = remove_repeats(docs_of(spark, rows)).collect()
    got = {row.doc_id: (row.n_words, row.n_removed, row.kept_text) for row in found}
    assert got == brute.without_repeats(rows)
    assert {row.doc for row in found} == {"extra"}


def test_other_lengths(spark):
    rows = passages(4)
    for length in (1, 3, 8):
        found = remove_repeats(docs_of(spark, rows), length=length).collect()
        got = {row.doc_id: (row.n_words, row.n_removed, row.kept_text) for row in found}
        assert got == brute.without_repeats(rows, length)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"x{at}" for at in range(25))
    rows = [(5, text), (5, text), (None, text), (9, text)]
    found = remove_repeats(docs_of(spark, rows)).collect()
    assert sorted(((row.doc_id, row.n_removed) for row in found), key=str) == sorted(
        [(5, 0), (5, 0), (None, 25), (9, 25)], key=str
    )
    assert remove_repeats(docs_of(spark, [])).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(100_000)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[5000:5100] + ["z"] * 10))]
    got = {row.doc_id: row.n_removed for row in remove_repeats(docs_of(spark, rows)).collect()}
    assert got == {1: 0, 2: 100}
