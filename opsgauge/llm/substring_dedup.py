"""Removal of passages that were seen before, found by level-wise doubling.

A passage of ``length`` words can repeat only if the shorter windows inside it do.  Level 1 counts windows
of a quarter of the length; of these it takes, from each window of full length, only the one with the smallest hash:
equal passages take the same one, so nothing is missed and about an eighth of all windows is counted.  Neighbouring
full windows that share their short one are a run; runs that are equal as a whole need no further
look.  The others, around short windows repeated at level 1, are extended: level 2 counts the first halves of
their windows, and of windows repeated at that length alone level 3 compares all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.llm.shared import bounded_batches, col, text_key, written
from opsgauge.llm.wordhash import EXACT, chunks, mixed, random_values, windows

LENGTH = 20


def _runs(hashes: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The full windows of some rows, in runs that share their smallest short window.

    Of each run: its short window's hash and place, its first window, its number of windows,
    its row.  Windows that cross rows are left out.
    """
    short = max(length // 4, 1)
    grams = windows(hashes, short)
    span = length - short + 1
    count = len(hashes) - length + 1
    if count <= 0:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty, empty
    # Leftmost smallest hash among ``span`` neighbours, by doubling.
    least, place, width = grams, np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        right, right_place = least[step:], place[step:]
        left, left_place = least[: len(right)], place[: len(right)]
        smaller = right < left
        least, place = np.where(smaller, right, left), np.where(smaller, right_place, left_place)
        width += step
    place = place[:count]
    row = np.searchsorted(firsts, np.arange(count), "right") - 1
    whole = np.arange(count) + length <= firsts[row + 1]
    at = np.flatnonzero(whole)
    if not len(at):
        return least[:0], at, at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(at)))
    start = at[begin]
    return grams[place[start]], place[start], start, sizes, row[start]


_RUN = "array<struct<short:bigint,run:bigint,start:int,count:int>>"


def _run_rows(length: int):
    """From texts to their runs: short window, hash of all full windows, first one, number of them."""

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            kept: list[tuple[np.ndarray, ...]] = []
            per_row = np.zeros(len(texts), np.int64)
            for low, high, hashes, firsts in chunks(texts, EXACT):
                grams, _, start, sizes, row = _runs(hashes, firsts, length)
                full = windows(hashes, length)
                inside = _inside(sizes)
                run = grams
                if len(inside):
                    factors = random_values(9, int(sizes.max())) | np.uint64(1)
                    listed = full[np.repeat(start, sizes) + inside] * factors[inside]
                    run = mixed(np.add.reduceat(listed, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
                kept.append((grams, run, start - firsts[row], sizes))
                per_row[low:high] = np.bincount(row, minlength=high - low)
            grams, run, start, sizes = _together(kept, 4)
            rows = pa.StructArray.from_arrays(
                [
                    pa.array(grams.view(np.int64)),
                    pa.array(run.view(np.int64)),
                    pa.array(start.astype(np.int32)),
                    pa.array(sizes.astype(np.int32)),
                ],
                ["short", "run", "start", "count"],
            )
            yield pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32), rows)

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(read, _RUN)


def _inside(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _together(parts: list[tuple[np.ndarray, ...]], count: int) -> list[np.ndarray]:
    return [np.concatenate(column) for column in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * count


_WINDOW = "array<struct<start:bigint,half:bigint,full:bigint>>"


def _run_windows(length: int):
    """From texts and places of runs to the windows of these: where they start, hashes of first half and whole."""

    def read(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts, counts in batches:
            kept: list[tuple[np.ndarray, ...]] = []
            per_row = np.zeros(len(texts), np.int64)
            cuts = starts.offsets.to_numpy()
            begin = starts.values.to_numpy(zero_copy_only=False)
            sizes = counts.values.to_numpy(zero_copy_only=False)
            for low, high, hashes, firsts in chunks(texts, EXACT):
                own = slice(cuts[low], cuts[high])
                base = np.repeat(firsts[:-1], np.diff(cuts[low : high + 1]))
                start = np.repeat(begin[own], sizes[own]) + _inside(sizes[own])
                place = np.repeat(base, sizes[own]) + start
                kept.append((start, windows(hashes, max(length // 2, 1), 5)[place], windows(hashes, length)[place]))
                for at in range(low, high):
                    per_row[at] = sizes[cuts[at] : cuts[at + 1]].sum()
            start, half, full = _together(kept, 3)
            rows = pa.StructArray.from_arrays(
                [pa.array(start.astype(np.int64)), pa.array(half.view(np.int64)), pa.array(full.view(np.int64))],
                ["start", "half", "full"],
            )
            yield pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32), rows)

    read.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(read, _WINDOW)


_CUT = "struct<n_words:bigint,n_removed:bigint,kept:binary>"


def _cutter(length: int):
    """From texts and the places of repeated windows to the words that stay."""

    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts, counts in batches:
            rows = []
            for text, begin, count in zip(
                texts.cast(pa.binary()).to_pylist(), starts.to_pylist(), counts.to_pylist(), strict=True
            ):
                # On bytes, split() parts words at exactly the six blanks.
                parts = (text or b"").split()
                words = len(parts)
                if begin:
                    edge = np.zeros(words + 1, np.int64)
                    begin = np.array(begin)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + np.array(count) + length - 1, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    parts = [parts[at] for at in np.flatnonzero(stays)]
                rows.append({"n_words": words, "n_removed": words - len(parts), "kept": b" ".join(parts)})
            yield pa.array(
                rows, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
            )

    cut.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(cut, _CUT)


def repeated_windows(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH
) -> DataFrame:
    """``doc, id, start, count``: ``count`` windows of ``length`` words from word ``start`` on that also start earlier.

    ``doc`` is the key of id and text.  Earlier means a smaller id (NULL ids come last; among equal
    ids the smaller text key), or the same document and an earlier word.
    """
    bounded_batches(docs.sparkSession)
    keyed = docs.select(
        col(id_column).alias("id"), text_key(col(text_column), col(id_column)).alias("doc"), col(text_column).alias("body")
    )
    # Level 1: one short window of each full one, with its run.  Texts are read for it but not shuffled.
    listed = written(keyed.select("doc", "id", F.explode(_run_rows(length)("body")).alias("r")).select("doc", "id", "r.*"), "listed")
    twice = written(_repeated(listed, "short"), "twice")
    runs = listed.join(twice.hint("merge"), "short", "left_semi")
    runs = written(runs.withColumn("start", F.col("start").cast("bigint")), "runs")

    place = F.struct(F.col("id").isNull().alias("noid"), "id", "doc", "start")
    # Runs that are equal as a whole: all but the first are repeats.
    first = written(
        runs.groupBy("run").agg(
            F.min(place).alias("at"),
            F.any_value("short").alias("short"),
            F.any_value("count").alias("count"),
            F.count("*").alias("n"),
        ),
        "first_runs",
    )
    seen = runs.select("run", "doc", "id", "start", F.col("count").cast("bigint").alias("count")).join(
        first.filter("n > 1").select("run", "at").hint("merge"), "run"
    )
    seen = seen.filter((F.col("doc") != F.col("at.doc")) | (F.col("start") != F.col("at.start")))
    # First runs that share a short window with a different one: look at their windows.
    contested = first.join(_repeated(first, "short").hint("merge"), "short", "left_semi")
    contested = contested.groupBy("at.doc").agg(F.collect_list(F.struct("at.start", "count")).alias("places"))
    found = keyed.join(contested.hint("merge"), "doc").select(
        "doc",
        "id",
        F.explode(_run_windows(length)("body", F.col("places.start"), F.col("places.count"))).alias("w"),
    )
    found = written(found.select("doc", "id", "w.*"), "windows")
    # Level 2, then level 3 for what is left.
    rows = found.join(_repeated(found, "half").hint("merge"), "half", "left_semi")
    rows = written(rows.select("doc", "id", "start", "full"), "survivors")
    earliest = rows.groupBy("full").agg(F.min(place).alias("at"), F.count("*").alias("n")).filter("n > 1")
    later = rows.join(earliest.select("full", "at").hint("merge"), "full").filter(
        (F.col("doc") != F.col("at.doc")) | (F.col("start") != F.col("at.start"))
    )
    return seen.select("doc", "id", "start", "count").union(
        later.select("doc", "id", "start", F.lit(1).cast("bigint").alias("count"))
    )


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """The values that several rows have, each once."""
    return rows.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").select(name)


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``, the words that stay, joined by a blank.

    A word goes if a window of ``length`` consecutive words around it also starts earlier: in a smaller
    id, or in the same document at an earlier word.  Windows are judged on the input.  Words
    are parted by the ASCII blanks and compared exactly.  NULL and empty texts and texts shorter
    than a window lose nothing; a NULL text has no words.  Rows with equal id and text are one document
    and lose the same words.  A column that has one of the new names is replaced.  No rows: no rows.
    """
    names = [name for name in docs.columns if name.lower() not in ("n_words", "n_removed", "kept_text")]
    repeats = repeated_windows(docs, id_column, text_column, length)
    cuts = written(
        repeats.groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("cuts")), "cuts"
    ).select("doc", F.col("cuts.start").alias("starts"), F.col("cuts.count").alias("counts"))
    # Plain columns, so that those nobody asks for, and a second copy of the text, are not shuffled.
    columns = {name: f"c{at}" for at, name in enumerate(names)}
    carried = [col(name).alias(short) for name, short in columns.items()]
    body = columns.get(text_column, "body")
    if text_column not in columns:
        carried.append(col(text_column).alias(body))
    keyed = docs.select(text_key(col(text_column), col(id_column)).alias("doc"), *carried)
    none = F.array().cast("array<bigint>")
    # By shuffle whatever the number of touched documents: the plan is the same at every size.
    joined = keyed.join(cuts.hint("merge"), "doc", "left").withColumns(
        {"starts": F.coalesce("starts", none), "counts": F.coalesce("counts", none)}
    )
    out = joined.select(*columns.values(), _cutter(length)(body, "starts", "counts").alias("cut"))
    return out.select(
        *[F.col(short).alias(name) for name, short in columns.items()],
        "cut.n_words",
        "cut.n_removed",
        F.col("cut.kept").cast("string").alias("kept_text"),
    )
