"""Quality classification by importance resampling.

Two bag-of-n-gram models over hashed words and word pairs are counted: one of target text
(labelled good), one of all raw text.  A document's importance is the ratio of the two.  A mean
over a long text hides a few words that good text never holds, so the same ratio is also taken of
documents that hold a word, labelled good to all labelled, and a document's worst word must pass a cut
of its own.  Documents are drawn without replacement by Gumbel top-k: noise is added to the log
weight and the largest sums stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.llm.shared import bounded_batches, col, fresh, text_key, written
from opsgauge.llm.wordhash import LOWER, chunks, windows

BUCKETS = 1 << 17
# Labelled rows used at most, the ones with the smallest hashes of their id.
MAX_LABELS = 20_000
# Counts added to what is seen and to what is expected, and the least absolute log ratio that is
# more than noise: rare and indifferent n-grams weigh nothing.
SHRINKAGE, MIN_RATIO = 2.0, 1.0
# Share of labelled good documents that each of the two cuts may lose.
LOSS = 0.005
# 1 draws exactly by importance; towards 0 the draw becomes a plain top-k.
TEMPERATURE = 0.1


@dataclass(frozen=True)
class ImportanceModel:
    """Log ratios of each bucket (words, then word pairs) and the cut of a document's mean ratio.

    ``words`` are the sorted hashes of words that good documents hold less often than others,
    ``word_ratios`` their log ratios and ``word_cut`` the cut of a document's least one.
    """

    ratios: np.ndarray
    cut: float
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    word_ratios: np.ndarray = field(default_factory=lambda: np.zeros(0))
    word_cut: float = float("-inf")


def _grams(hashes: np.ndarray, firsts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and of all word pairs inside a row, and the row of each."""
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    pairs = windows(hashes, 2)
    inside = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    mask = np.uint64(buckets - 1)
    one = (hashes & mask).astype(np.int64)
    two = (pairs[inside] & mask).astype(np.int64) + buckets
    return np.concatenate([one, two]), np.concatenate([row, row[1:][inside] if len(row) else row])


def _counts(docs: DataFrame, text: str, chosen: str, buckets: int) -> DataFrame:
    """``bucket, raw, target``: the counts of all rows and of the ``chosen`` ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * buckets, np.int64), np.zeros(2 * buckets, np.int64)
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for low, high, hashes, firsts in chunks(batch.column(0), LOWER):
                grams, row = _grams(hashes, firsts, buckets)
                raw += np.bincount(grams, minlength=2 * buckets)
                target += np.bincount(grams[wanted[low:high][row]], minlength=2 * buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"]
        )

    parts = docs.select(col(text), col(chosen)).mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def _documents_with(docs: DataFrame, text: str, good: str) -> DataFrame:
    """``word, good, bad``: how many good and other rows hold a word, by its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for low, high, hashes, firsts in chunks(batch.column(0), LOWER):
                row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
                order = np.lexsort((hashes, row))
                word, row = hashes[order], row[order]
                # Each word once a row.
                new = np.ones(len(row), bool)
                new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
                words, place = np.unique(word[new], return_inverse=True)
                all_rows = np.bincount(place, minlength=len(words))
                in_good = np.bincount(place[wanted[low:high][row[new]]], minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.view(np.int64)), pa.array(in_good), pa.array(all_rows - in_good)], ["word", "good", "bad"]
                )

    parts = docs.select(col(text), col(good)).mapInArrow(count, "word bigint, good bigint, bad bigint")
    return parts.groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def _bad_words(fit: DataFrame, shrinkage: float, min_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """The words that good documents of ``fit`` hold less often than others, by hash, and their log ratios."""
    good, total = fit.agg(F.count_if("good"), F.count("*")).first()
    expected = (F.col("good") + F.col("bad")) * F.lit(good / total)
    ratio = F.log((F.col("good") + F.lit(shrinkage)) / (expected + F.lit(shrinkage)))
    found = _documents_with(fit, "text", "good").select("word", ratio.alias("ratio"))
    # Words of at most max_labels documents, each in several bad ones.
    rows = found.filter(F.col("ratio") <= F.lit(-min_ratio)).collect()
    words = np.array([row["word"] for row in rows], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([row["ratio"] for row in rows], float)[order]


def _weigher(model, buckets: int):
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, words, word_ratios = model.value
        mask = np.uint64(buckets - 1)
        # Whether a bucket holds such a word: few do, so that few are searched for.
        marked = np.zeros(buckets, bool)
        marked[(words & mask).astype(np.int64)] = True
        for texts in batches:
            grams_of, total, worst = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            for low, high, hashes, firsts in chunks(texts, LOWER):
                grams, row = _grams(hashes, firsts, buckets)
                grams_of[low:high] = np.bincount(row, minlength=high - low)
                total[low:high] = np.bincount(row, table[grams], minlength=high - low)
                # Words come before pairs.
                at = np.flatnonzero(marked[grams[: len(hashes)]])
                if len(at):
                    place = np.minimum(np.searchsorted(words, hashes[at]), len(words) - 1)
                    same = words[place] == hashes[at]
                    np.minimum.at(worst, low + row[at[same]], word_ratios[place[same]])
            yield pa.StructArray.from_arrays([pa.array(grams_of), pa.array(total), pa.array(worst)], ["grams", "total", "worst"])

    weigh.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(weigh, "struct<grams:bigint,total:double,worst:double>")


def _weighed(docs: DataFrame, model: ImportanceModel, text_column: str, name: str) -> DataFrame:
    """``docs`` with the number of n-grams, the sum of their log ratios and the least one of a word."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.ratios, model.words, model.word_ratios))
    return docs.withColumn(name, _weigher(sent, len(model.ratios) // 2)(col(text_column)))


def _labelled(docs: DataFrame, labels: DataFrame, id_column: str, max_labels: int) -> DataFrame:
    """``docs`` with ``good`` and ``fit`` of at most ``max_labels`` labelled ids; NULL for the others."""
    one = labels.filter(col(id_column).isNotNull()).groupBy(col(id_column).alias("labelled")).agg(
        F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")
    )
    dice = F.xxhash64("labelled", F.lit(17))
    chosen = one.filter("good IS NOT NULL").orderBy(dice, "labelled").limit(max_labels)
    chosen = chosen.withColumn("fit", F.pmod(F.xxhash64("labelled", F.lit(18)), F.lit(4)) != 0)
    # Bounded by max_labels rows.
    return docs.join(F.broadcast(chosen), col(id_column) == F.col("labelled"), "left")


def fit_importance(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
    max_labels: int = MAX_LABELS,
    shrinkage: float = SHRINKAGE,
    min_ratio: float = MIN_RATIO,
    loss: float = LOSS,
) -> ImportanceModel:
    """Count the target and the raw model and choose the cut.

    The raw model counts all of ``docs``.  The target model counts the documents labelled good (quality 1, not toxic)
    among three quarters of at most ``max_labels`` labels; on the remaining quarter the cut is
    chosen between good and bad documents, and so is that of the worst word.  Words are
    counted by documents of the same three quarters.  Contradicting labels of one id count as
    bad; a NULL quality is no label.  Without good labels every ratio and the cut are 0.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(col(id_column).alias("id"), col(text_column).alias("text"))
    labels = labels.select(col(id_column).alias("id"), "quality", "toxic")
    marked = _labelled(plain, labels, "id", max_labels)
    counted = marked.withColumn("chosen", F.coalesce(F.col("good") & F.col("fit"), F.lit(False)))
    raw, target = np.zeros(2 * buckets), np.zeros(2 * buckets)
    # At most 2 x buckets rows.
    for bucket, in_raw, in_target in _counts(counted, "text", "chosen", buckets).collect():
        raw[bucket], target[bucket] = in_raw, in_target
    ratios = np.zeros(2 * buckets)
    for part in (slice(0, buckets), slice(buckets, None)):
        if target[part].sum():
            expected = raw[part] * (target[part].sum() / raw[part].sum())
            logs = np.log((target[part] + shrinkage) / (expected + shrinkage))
            ratios[part] = np.where(np.abs(logs) < min_ratio, 0.0, logs)
    if not target.sum():
        return ImportanceModel(ratios, 0.0)
    words, word_ratios = _bad_words(marked.filter("fit"), shrinkage, min_ratio)
    model = ImportanceModel(ratios, 0.0, words, word_ratios)
    held = marked.filter(~F.col("fit"))
    rows = _weighed(held, model, "text", "found").select("good", "found.*").filter("grams > 0")
    # At most max_labels rows.
    rows = rows.select("good", (F.col("total") / F.col("grams")).alias("mean"), "worst").collect()
    good, bad = (np.array([row[1:] for row in rows if row["good"] == kind]).reshape(-1, 2) for kind in (True, False))
    cut, word_cut = (_cut(np.sort(good[:, at]), np.sort(bad[:, at]), loss) for at in (0, 1))
    return ImportanceModel(ratios, cut, words, word_ratios, word_cut if len(good) else float("-inf"))


def _cut(good: np.ndarray, bad: np.ndarray, loss: float) -> float:
    """The largest useful cut that loses at most a share ``loss`` of the good, in the middle of its gap."""
    if not len(good):
        return 0.0
    high = good[int(loss * len(good))]
    below = bad[bad < high]
    return float((high + below[-1]) / 2) if len(below) else float(high - abs(high))


def importance(
    docs: DataFrame, model: ImportanceModel, text_column: str = "text", name: str = "log_weight", grams_name: str = "n_grams"
) -> DataFrame:
    """``docs`` with the log importance weight of each text, relative to the model's cuts, and its number of n-grams.

    The weight is the number of n-grams times what the mean ratio is above its cut, or times what the
    worst word is below its own, if that is less.  NULL and empty texts weigh 0.
    """
    [found] = fresh(docs.columns, "found")
    out = _weighed(docs, model, text_column, found)
    grams, worst = col(found)["grams"], col(found)["worst"]
    weight = col(found)["total"] - F.lit(model.cut) * grams
    below = F.when(worst < F.lit(model.word_cut), (worst - F.lit(model.word_cut)) * grams)
    return out.withColumns({name: F.least(weight, below), grams_name: grams}).drop(found)


def kth_largest(rows: DataFrame, key: str, k: int) -> float | None:
    """The exact ``k``-th largest value of ``key``, by counting ever finer histograms; None if there is none."""
    total, low, high = rows.agg(F.count(key), F.min(key), F.max(key)).first()
    if k < 1 or total < k:
        return None
    left = rows.select(col(key).alias("key"))
    while low < high:
        place = F.floor((F.col("key") - F.lit(low)) / F.lit(high - low) * 1024)
        parts = left.filter(F.col("key").between(low, high)).groupBy(place.alias("place"))
        parts = parts.agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for part in sorted(parts.collect(), key=lambda row: -row["low"]):
            if k <= part["n"]:
                low, high = part["low"], part["high"]
                break
            k -= part["n"]
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    count: int | None = None,
    temperature: float = TEMPERATURE,
    seed: int = 0,
    **options,
) -> DataFrame:
    """``docs`` with ``log_weight``, ``draw`` and ``kept``.

    ``draw`` is the log weight plus ``temperature`` times Gumbel noise; the ``count`` largest are
    kept, by default as many as there are documents with a weight of at least 0, which are
    those nearer to the target than the cut.  The noise is a hash of id, text and ``seed``: runs agree,
    and equal rows share their fate (rows that tie with the last one kept stay too).
    NULL and empty texts weigh 0.  Columns with the new names are replaced.  No rows: no rows.
    """
    model = fit_importance(docs, labels, id_column, text_column, **options)
    return _draw(docs, model, id_column, text_column, count, temperature, seed)


def _draw(docs, model, id_column, text_column, count, temperature, seed) -> DataFrame:
    weighed = importance(docs, model, text_column, "log_weight", "n_grams")
    dice = text_key(col(text_column), col(id_column), F.lit(seed))
    uniform = (F.pmod(dice, F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    drawn = weighed.withColumn("draw", F.col("log_weight") - temperature * F.log(-F.log(uniform)))
    keys = written(drawn.select("log_weight", "draw"), "draws")
    if count is None:
        count = keys.filter("log_weight >= 0").count()
    least = kth_largest(keys, "draw", count) if count < keys.count() else float("-inf")
    return drawn.withColumn("kept", F.lit(False) if least is None else F.col("draw") >= F.lit(least))


def keep_best(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that resampling keeps, columns unchanged."""
    inner = fresh(docs.columns, "row")[0]
    packed = docs.select(
        col(id_column).alias("id"),
        col(options.pop("text_column", "text")).alias("text"),
        F.struct(*[col(name) for name in docs.columns]).alias(inner),
    )
    labels = labels.select(col(id_column).alias("id"), "quality", "toxic")
    kept = resample(packed, labels, "id", "text", **options).filter("kept")
    return kept.select(*[col(inner)[name].alias(name) for name in docs.columns])
