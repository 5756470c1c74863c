from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from opsgauge.llm import near_duplicates as nd
from opsgauge.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, id string, text_key int"


def rows_of(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(doc, text, "x", 1) for doc, text in rows], SCHEMA)


def some_texts(seed):
    """Groups of edited copies, copies, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"W{at}" for at in range(300)]
    rows = []
    for _ in range(8):
        base = rng.choices(vocabulary, k=rng.randint(30, 120))
        for _ in range(rng.randint(1, 7)):
            rows.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
    rows += ["", "  \n ", "one two", "One  TWO", "one two three four", "Ünï çödé ONE", None, None]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = some_texts(seed)
    expected = brute.near_duplicates(rows)
    found = nd.near_duplicates(rows_of(spark, rows), shingle_words=4).collect()
    assert {row.id: (row.n_shingles, row.component_id) for row in found} == expected
    assert all(row.first == (row.id == row.component_id) for row in found)


def test_chain_of_edits_in_blocks(spark, monkeypatch):
    # Each text is near the next one only; blocks of 4 members and no light buckets.
    monkeypatch.setattr(nd, "BLOCK_ROWS", 4)
    monkeypatch.setattr(nd, "LIGHT_PAIRS", 0)
    rng = random.Random(5)
    base, rows = [f"v{at}" for at in range(60)], []
    for at in range(30):
        rows.append((at, " ".join(base)))
        base[rng.randrange(60)] = f"n{at}"
    expected = brute.near_duplicates(rows)
    found = nd.near_duplicates(rows_of(spark, rows), shingle_words=4).collect()
    assert {row.id: (row.n_shingles, row.component_id) for row in found} == expected


def test_joined_copies_of_a_light_bucket_form_no_pairs(spark):
    # A hundred copies joined under node 1, two that are apart from them.
    joined = spark.range(1, 101).selectExpr("7L bucket", "id node", "1L root", "1L top")
    others = spark.range(200, 202).selectExpr("7L bucket", "id node", "id root", "1L top")
    pairs = nd._light_pairs(joined.union(others)).collect()
    assert len(pairs) == 2 * 100 + 1
    assert len({frozenset((row.node, row.node2)) for row in pairs}) == len(pairs)
    assert all(row.root != row.root2 for row in pairs)


def test_rounds_and_pairs_agree(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_PAIRS", 0)
    rows = some_texts(3)
    found = nd.near_duplicates(rows_of(spark, rows), shingle_words=4).collect()
    assert {row.id: (row.n_shingles, row.component_id) for row in found} == brute.near_duplicates(rows)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    long = " ".join(f"w{at}" for at in range(40))
    rows = [(None, long), (7, long), (7, long), (3, long + " more"), (None, "alone here in five words"), (5, None)]
    found = nd.near_duplicates(rows_of(spark, rows)).collect()
    assert len(found) == len(rows)
    named = sorted(((row.id, row.component_id, row.first) for row in found), key=str)
    assert named == sorted(
        [(None, 3, False), (7, 3, False), (7, 3, False), (3, 3, True), (None, None, True), (5, 5, True)], key=str
    )
    assert nd.near_duplicates(rows_of(spark, [])).count() == 0


def test_one_of_each_keeps_one_row_and_all_columns(spark):
    long = " ".join(f"w{at}" for at in range(40))
    rows = [(2, long), (2, long), (9, long + " x"), (4, ""), (4, ""), (8, "quite another text with some words")]
    docs = rows_of(spark, rows)
    kept = nd.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(row.doc_id for row in kept.collect()) == [2, 4, 4, 8]
    assert nd.one_of_each(rows_of(spark, [])).count() == 0


def test_very_long_text_and_long_word(spark):
    long = " ".join(f"w{at % 5000}" for at in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "y" * 3_000_000), (4, "z " + "y" * 3_000_000)]
    found = {row.id: row.component_id for row in nd.near_duplicates(rows_of(spark, rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_search(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + at, 301 + at) for at in range(20)]
    edges += [(500, 500 + at) for at in range(50)] + edges[:5] + [(None, 1), (2, None), (3, 3)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    expected = brute.components([e for e in edges if None not in e and e[0] != e[1]])
    assert {row.node: row.root for row in found} == {n: r for n, r in expected.items() if n != r}
    assert len(found) == len({row.node for row in found})


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_signature_agreement_is_the_similarity(spark):
    # The share of equal bands of one value estimates the similarity without bias.
    words = lambda last: F.transform(F.sequence(F.lit(0), F.lit(last)), lambda x: (F.col("id") * 1000 + x).cast("string"))
    left = spark.range(400).select("id", F.concat_ws(" ", words(99)).alias("t")).orderBy("id")
    right = spark.range(400).select("id", F.concat_ws(" ", words(124)).alias("t")).orderBy("id")
    sign = nd._signer(1, 32, 1)
    a = [row.s.bands for row in left.select(sign("t").alias("s")).collect()]
    b = [row.s.bands for row in right.select(sign("t").alias("s")).collect()]
    equal = sum(x == y for own, other in zip(a, b, strict=True) for x, y in zip(own, other, strict=True)) / (400 * 32)
    assert abs(equal - 0.8) < 0.02
