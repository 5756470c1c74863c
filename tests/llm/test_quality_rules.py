from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from opsgauge.llm.quality_rules import COMMON_WORDS, js_distance, quality_profile, quality_rules
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, t int, words string, profile int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*row, 1, "x", 2) for row in rows], SCHEMA)


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for doc in range(80):
        lang = rng.choice(["en", "de", "fr", "es", "xx", None])
        vocabulary = COMMON_WORDS.get(lang, ["q"]) + [f"wort{at}" for at in range(rng.choice([3, 60]))] + ["Ä#$", "|", "X9*"]
        parts = rng.choices(vocabulary, k=rng.choice([0, 3, 5, 9, 30, 200]))
        text = "".join(part + rng.choice([" ", "  ", "\n", "\t", "\n\n", " \n"]) for part in parts)
        rows.append((doc, rng.choice(["", " ", "\n"]) + text, lang))
    return rows + [(100, None, "en"), (101, "", None), (102, "a b c d e a b c d e", "en"), (103, "l\nl\n \n \nl", "en")]


def test_counts_equal_brute_force(spark):
    rows = sample(1)
    found = quality_rules(docs_of(spark, rows)).collect()
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found}
    assert got == {doc: brute.base_quality(text) for doc, text, _ in rows}
    for row in found:
        assert row.base_failed == (row.n_words < 10 or row.n_repeat_words * 100 > row.n_words * 20)
        assert not (row.base_failed and row.kept)


def test_histograms(spark):
    row = quality_profile(docs_of(spark, [(1, "The the of OF x1 Ünd #a.\n", "en")])).first()
    assert row["text"].startswith("The") and row["t"] == 1 and row["words"] == "x"
    assert row["profile"]["common"] == [2, 1] + [0] * 10 + [4]
    assert row["profile"]["chars"] == [11, 7, 3, 1, 1, 1, 1]


def test_other_text_is_far_and_short_text_is_not_judged(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choices(["the", "of", "and", "sun", "moon", "river", "a"], k=n))
    good = [(at, prose(150), "en") for at in range(20)]
    odd = [(100, " ".join(f"{rng.randrange(10**6)}|" for _ in range(150)), "en"), (101, " ".join(f"Zz{at}!" for at in range(12)), "en")]
    found = {row.id: row for row in quality_rules(docs_of(spark, good + odd)).collect()}
    assert all(found[doc].kept for doc, _, _ in good)
    assert not found[100].kept and found[100].char_distance > 0.5
    assert found[101].kept and found[101].char_distance is None and found[101].word_distance is None


@pytest.mark.parametrize(("p", "q"), [([1, 2, 3], [3, 2, 1]), ([5, 0, 1], [0, 5, 1]), ([2, 4], [1, 2]), ([1, 0], [0, 1]), ([0, 0], [1, 1])])
def test_distance(spark, p, q):
    def exact():
        if not sum(p) or not sum(q):
            return None
        a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
        m = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
        kl = lambda u: sum(x * math.log2(x / y) for x, y in zip(u, m, strict=True) if x)
        return math.sqrt(max((kl(a) + kl(b)) / 2, 0))

    arrays = [F.array(*[F.lit(x) for x in side]).cast("array<bigint>") for side in (p, q)]
    assert spark.range(1).select(js_distance(*arrays)).first()[0] == pytest.approx(exact(), abs=1e-9)


def test_empty_table_and_no_languages(spark):
    assert quality_rules(docs_of(spark, [])).count() == 0
    found = quality_rules(docs_of(spark, [(1, "just some words that no list of words is about at all", None)] * 2)).collect()
    assert [row.kept for row in found] == [True, True]


def test_very_long_text(spark):
    text = " ".join(f"w{at}" for at in range(200_000))
    row = quality_rules(docs_of(spark, [(1, text, "en")])).first()
    assert (row.n_words, row.n_repeat_words) == (200_000, 0)
