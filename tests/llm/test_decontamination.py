from __future__ import annotations

import random

import pytest

from opsgauge.llm import decontamination as dc
from opsgauge.llm.decontamination import contamination, without_contaminated
from tests.llm import brute


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(doc, text, 1) for doc, text in docs], "doc_id bigint, text string, hits int"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )


def sample(seed):
    rng = random.Random(seed)
    vocabulary = [f"Word{at}" for at in range(50)] + ["été", "Ünter", "日本"]
    items = [(at, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 30])))) for at in range(12)]
    items += [(3, items[3][1]), (50, None), (51, " ,; "), (None, " ".join(vocabulary[:12]))]
    docs = []
    for doc in range(60):
        parts = rng.choices(vocabulary, k=rng.randint(0, 60))
        if rng.random() < 0.6:
            at, own = rng.randint(0, len(parts)), (rng.choice(items)[1] or "").split()
            parts[at:at] = own[rng.randint(0, 2) :]
        docs.append((doc, rng.choice([" ", ", ", "\n-- "]).join(parts).swapcase() if doc % 3 else " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "...")], items


@pytest.mark.parametrize("block_bytes", [1, 10**6])
def test_equals_brute_force(spark, block_bytes):
    docs, items = sample(1)
    expected = brute.contamination(docs, items)
    left, right = frames(spark, docs, items)
    found = contamination(left, right, block_bytes=block_bytes).collect()
    got = {row.doc_id: (row.contamination.n_words, row.contamination.n_hit, row.contamination["items"]) for row in found}
    assert got == {doc: (n, len(hit), ids) for doc, (n, hit, ids) in expected.items()}
    texts = dict(docs)
    for row in found:
        # Spans lead back to the original text.
        parts = [brute.NORMAL_WORD.findall(brute.lower(texts[row.doc_id][s.start : s.end])) for s in row.contamination.spans]
        assert sum(map(len, parts)) == row.contamination.n_hit
        assert all(part for part in parts)


def test_only_clean_rows_stay(spark):
    docs, items = sample(2)
    left, right = frames(spark, docs, items)
    kept = without_contaminated(left, right)
    assert kept.columns == left.columns
    clean = [doc for doc, (_, hit, _) in brute.contamination(docs, items).items() if not hit]
    assert sorted(row.doc_id for row in kept.collect()) == sorted(clean)


def test_empty_tables(spark):
    docs, items = sample(3)
    left, right = frames(spark, docs, [])
    assert contamination(left, right).filter("contamination.n_hit > 0").count() == 0
    left, right = frames(spark, [], items)
    assert contamination(left, right).count() == 0


def test_very_long_text_and_repeated_rows(spark):
    question = " ".join(f"q{at}" for at in range(15))
    long = "x " * 400_000 + question.upper() + " y" * 400_000
    left, right = frames(spark, [(1, long), (1, long), (None, question)], [(7, question)])
    found = contamination(left, right).collect()
    assert [row.contamination.n_hit for row in found] == [15, 15, 15]
    assert {(s.start, s.end) for row in found if row.doc_id for s in row.contamination.spans} == {
        (800_000, 800_000 + len(question))
    }


def test_a_worker_keeps_the_automata_of_one_query():
    class Sent:
        value = sorted(dc.windows_of([("a", "one two three")], 10).items())

    first = dc._kept_automaton("x", 0, Sent)
    assert dc._kept_automaton("x", 0, Sent) is first
    dc._kept_automaton("x", 1, Sent)
    dc._kept_automaton("y", 0, Sent)
    query, blocks = dc.worker_cache()["windows"]
    assert (query, list(blocks)) == ("y", [0])
