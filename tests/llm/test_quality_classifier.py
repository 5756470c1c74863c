from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from opsgauge.llm.quality_classifier import fit_importance, importance, keep_best, kth_largest, resample

SCHEMA = "doc_id bigint, text string, kept string, id int"


def corpus(spark, seed=1, size=400):
    rng = random.Random(seed)
    good_words, bad_words = [f"word{at}" for at in range(200)], ["moron", "trash", "%%%", "buy!!"]
    rows, labels = [], []
    for doc in range(size):
        bad = doc % 4 == 0
        parts = rng.choices(good_words, k=rng.randint(60, 200))
        if bad:
            for at in range(0, len(parts), 12):
                parts[at] = rng.choice(bad_words)
        rows.append((doc, " ".join(parts)))
        if doc % 3:
            labels.append((doc, int(not bad), int(bad and doc % 8 == 0)))
    return rows, labels


def frames(spark, rows, labels):
    return (
        spark.createDataFrame([(doc, text, "old", 5) for doc, text in rows], SCHEMA),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_held_out_accuracy(spark):
    rows, labels = corpus(spark)
    docs, labelled = frames(spark, rows, labels)
    found = {row.doc_id: row.kept for row in resample(docs, labelled).collect()}
    unseen = [doc for doc, _ in rows if doc % 3 == 0]
    right = sum(found[doc] == (doc % 4 != 0) for doc in unseen)
    assert right / len(unseen) > 0.95


def test_one_bad_word_counts_in_texts_of_any_length(spark):
    rng = random.Random(5)
    words = [f"word{at}" for at in range(300)]
    rows, labels = [], []
    for doc in range(600):
        bad = doc % 4 == 0
        parts = rng.choices(words, k=3000 if doc % 40 == 0 else rng.randint(30, 120))
        if bad:
            parts[len(parts) // 2] = rng.choice(["moron", "scum"])
        # Good documents with many words that are common in unlabelled ones only.
        elif doc % 3 == 0:
            parts = ["odd", "strange"] * 50
        elif doc % 10 == 1:
            parts[::10] = ["odd"] * len(parts[::10])
        rows.append((doc, " ".join(parts)))
        if doc % 3:
            labels.append((doc, 1, int(bad)))
    docs, labelled = frames(spark, rows, labels)
    kept = {row.doc_id for row in resample(docs, labelled).filter("kept").collect()}
    bad = {doc for doc in range(600) if doc % 4 == 0}
    good = {doc for doc in range(600) if doc % 4 and doc % 3}
    assert not kept & bad
    assert len(kept & good) > 0.95 * len(good)


def test_weights_equal_the_log_ratios(spark):
    rows, labels = corpus(spark, size=40)
    docs, labelled = frames(spark, rows, labels)
    model = fit_importance(docs, labelled)
    # Unseen words have ratio 0, so that only the cut remains.
    row = importance(docs.limit(1).withColumn("text", F.lit("never seen")), model).first()
    assert row.n_grams == 3 and abs(row.log_weight + 3 * model.cut) < 1e-9
    assert np.isfinite(model.ratios).all() and (model.ratios != 0).any()


def test_columns_stay_and_runs_agree(spark):
    rows, labels = corpus(spark)
    docs, labelled = frames(spark, rows, labels)
    one, two = (sorted(map(tuple, keep_best(docs, labelled).collect())) for _ in range(2))
    assert one == two and 0 < len(one) < len(rows)
    assert keep_best(docs, labelled).columns == docs.columns


def test_count_is_a_top_k(spark):
    rows, labels = corpus(spark)
    docs, labelled = frames(spark, rows, labels)
    for count in (0, 1, 37, len(rows), 10**6):
        assert resample(docs, labelled, count=count).filter("kept").count() == min(count, len(rows))


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(500)] + [1.5] * 100 + [1e300, -1e300]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 100, 501, 602):
        assert kth_largest(frame, "v", k) == order[k - 1]
    assert kth_largest(frame, "v", 603) is None and kth_largest(frame.limit(0), "v", 1) is None


def test_nulls_empty_tables_and_odd_labels(spark):
    rows, labels = corpus(spark)
    rows += [(900, None), (901, ""), (None, "word1 word2"), (900, None), (902, "z" * 100_000)]
    labels += [(1, 0, 0), (None, 1, 0), (900, 1, None), (950, None, 0)]
    docs, labelled = frames(spark, rows, labels)
    found = resample(docs, labelled).collect()
    assert len(found) == len(rows)
    assert all(row.log_weight == 0 for row in found if not row.text)
    assert resample(docs.limit(0), labelled).count() == 0
    assert resample(docs, labelled.limit(0)).filter("kept").count() == len(rows)
