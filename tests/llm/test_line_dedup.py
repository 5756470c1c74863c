from __future__ import annotations

import random

import pyarrow as pa
import pytest

from opsgauge.llm import line_dedup
from opsgauge.llm.line_dedup import kept_bits, line_bitmaps, without_repeated_lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(line):
    return line.strip(BLANKS).translate(LOWER)


def brute(docs, min_chars=20, min_docs=3):
    """``(id, text)`` to ``(id, n_lines, n_dropped, kept)``, sorted."""
    holders: dict = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= min_chars:
                holders.setdefault(_key(line), set()).add(doc)
    found = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get(_key(line), ())
            largest = max(ids, key=lambda i: (i is not None, i or 0)) if ids else None
            if len(ids) < min_docs or doc == largest:
                kept.append(line)
        found.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(found, key=repr)


def _result(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = without_repeated_lines(df, **more).select("doc_id", "n_lines", "n_dropped", "kept_text")
    return sorted((tuple(row) for row in got.collect()), key=repr)


LONG = "this line is long enough to count"


def test_cases(spark):
    docs = [
        (1, f"{LONG}\nown line of document one\n  {LONG.upper()}\t"),
        (2, f"x\n{LONG}"),
        (3, LONG),
        (4, None),
        (5, ""),
        (6, "short line\nshort line"),
        (7, "short line"),
        (8, "short line"),
        (9, "ä" * 20 + "\n" + "Ä" * 20),
        (10, "ä" * 20),
        (11, "ä" * 20 + "\r"),
        (None, LONG),
        (3, f"{LONG}\nanother text of the same id"),
        (2, f"x\n{LONG}"),
        (12, "\n".join(["only in two documents, often"] * 5)),
        (13, "only in two documents, often"),
    ]
    assert _result(spark, docs) == brute(docs)


def test_random_lines(spark):
    random.seed(5)
    pool = [f"line number {n} of a shared pool" for n in range(12)] + ["tiny", "", "   "]
    docs = [(doc, "\n".join(random.choices(pool, k=random.randrange(0, 9)))) for doc in range(60)]
    docs += [(100 + doc, "line number 3 of a shared pool\n" * 40) for doc in range(30)]
    assert _result(spark, docs) == brute(docs)
    assert _result(spark, docs, min_chars=3, min_docs=2) == brute(docs, 3, 2)


def test_very_long_text_empty_table_and_clashing_columns(spark):
    long_text = "\n".join(f"filler line {n} of a very long text" for n in range(20_000))
    docs = [(1, long_text), (2, long_text), (3, long_text + "\nmore"), (4, "rest")]
    assert _result(spark, docs) == brute(docs)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert without_repeated_lines(none).count() == 0 and line_bitmaps(none).count() == 0
    odd = spark.createDataFrame([(1, LONG, 7, "k", 1.0)], "doc_id long, text string, n_lines int, Kept_Text string, id double")
    row = without_repeated_lines(odd).first()
    assert (row.doc_id, row.n_lines, row.kept_text, row["id"]) == (1, 1, LONG, 1.0)


def test_bitmaps_come_without_texts(spark):
    docs = spark.createDataFrame([(doc, f"a\n{LONG}\nb\nc") for doc in range(5)], "doc_id long, text string")
    found = line_bitmaps(docs)
    assert found.columns == ["id", "doc", "bitmap"]
    rows = {row.id: kept_bits(bytes(row.bitmap), 4).tolist() for row in found.collect()}
    assert rows == {doc: [True, False, True, True] for doc in range(4)}
    assert kept_bits(None, 3).all()


def _stream(tasks, min_docs):
    """Lines dropped by streaming over sorted ``(key, id, doc)`` rows, cut into tasks and batches."""
    schema = pa.schema([("key", pa.binary()), ("id", pa.int64()), ("doc", pa.int64()), ("lines", pa.list_(pa.int32()))])
    got = []
    for batches in tasks:
        made = [
            pa.RecordBatch.from_pydict(
                {"key": [bytes([r[0]]) for r in part], "id": [r[1] for r in part], "doc": [r[2] for r in part], "lines": [[0]] * len(part)},
                schema,
            )
            for part in batches
        ]
        for batch in line_dedup._streamed(min_docs)(iter(made)):
            got += [tuple(row.values())[:4] for row in batch.to_pylist()]
    edges: dict = {}
    for kind, key, doc, _ in got:
        if kind == line_dedup._EDGE:
            edges.setdefault(key, set()).add(doc)
    dropped = {(key[0], i, d) for kind, key, i, d in got if kind == line_dedup._DROP}
    for kind, key, i, d in got:
        if kind == line_dedup._OPEN and len(edges[key]) >= min_docs and i != _largest(edges[key]):
            dropped.add((key[0], i, d))
    return dropped


def _largest(ids):
    return max(ids, key=lambda i: (i is not None, i or 0))


@pytest.mark.parametrize("held", [0, 2, 10_000])
def test_groups_cut_by_batches_and_tasks(monkeypatch, held):
    monkeypatch.setattr(line_dedup, "_HELD_ROWS", held)
    random.seed(held)
    for _ in range(500):
        min_docs = random.choice([2, 3, 4])
        rows = {(random.randrange(4), random.choice([1, 2, 3, 4, 5, None]), random.randrange(3)) for _ in range(random.randrange(1, 25))}
        rows = sorted(rows, key=lambda r: (r[0], -(r[1] or 0), r[2]))
        cuts = sorted(random.randrange(len(rows) + 1) for _ in range(2))
        tasks = []
        for part in (rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :]):
            batches = []
            while part:
                size = random.randrange(1, 6)
                batches.append(part[:size])
                part = part[size:]
            tasks.append(batches)
        expected = set()
        for key in range(4):
            ids = {r[1] for r in rows if r[0] == key}
            if len(ids) >= min_docs:
                expected |= {r for r in rows if r[0] == key and r[1] != _largest(ids)}
        assert _stream(tasks, min_docs) == expected
