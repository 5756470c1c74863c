"""Removal of lines that many documents share, decided on sorted hashes and returned as bitmaps.

Each document sends one narrow row for each of its different long lines: a 128-bit hash, its id, the
line's places.  These rows are range-partitioned and sorted by hash and document, largest id first, so
that each task streams over groups of equal lines: the first occurrence stays, and from the third document
on the others go.  Since ids are part of the range, a line that a third of all documents hold is spread over
many tasks; groups that the ends of a task cut are decided by a merge of a few ids for each cut.  What
comes back for each document is a compressed bitmap of the lines that stay; texts are not part of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.llm.shared import bounded_batches, col, small, text_key, written

MIN_CHARS = 20
MIN_DOCS = 3
_BLANKS = b" \t\n\x0b\x0c\r"
# Rows of an open group that are kept back at most; a group with more is decided by the merge.
_HELD_ROWS = 10_000
_DROP, _OPEN, _EDGE = 0, 1, 2


def _line_keys(min_chars: int):
    """From texts to their different long lines: hash of the key, places."""

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            keys, places, per_key, per_row = [], [], [], []
            for text in texts.cast(pa.binary()).to_pylist():
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate((text or b"").split(b"\n")):
                    if len(line) >= min_chars:
                        # On bytes, lower() changes exactly A-Z.
                        key = line.strip(_BLANKS).lower()
                        if len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars:
                            found.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                keys.extend(found)
                per_row.append(len(found))
                for own in found.values():
                    places.extend(own)
                    per_key.append(len(own))
            lists = pa.ListArray.from_arrays(_offsets(per_key), pa.array(places, pa.int32()))
            rows = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), lists], ["key", "lines"])
            yield pa.ListArray.from_arrays(_offsets(per_row), rows)

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(read, "array<struct<key:binary,lines:array<int>>>")


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each row differs from the one before; the first one does.  NULL equals NULL."""
    new = np.ones(len(column), bool)
    if len(column) > 1:
        left, right = column[:-1], column[1:]
        same = pc.fill_null(pc.equal(left, right), False)
        same = pc.or_(same, pc.and_(pc.is_null(left), pc.is_null(right)))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    return new


def _streamed(min_docs: int):
    """Over rows sorted by key and document: lines to drop, rows to be decided later, ids at the task's ends."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None  # the group that is still open at the end of a batch
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            keys, ids = batch.column("key"), batch.column("id")
            new_key = _changes(keys)
            new_id = _changes(ids) | new_key
            begins = np.flatnonzero(new_key)
            out: list[pa.RecordBatch] = []
            low = 0
            if group is not None and keys[0].as_py() == group.key:
                # The open group goes on.
                low = int(begins[1]) if len(begins) > 1 else batch.num_rows
                group.add(batch.slice(0, low), new_id[:low], out)
            high = max(int(begins[-1]), low)
            if low < batch.num_rows:
                if group is not None:
                    group.close(out)
                first = group is None
                if first and low < high:
                    # The task's first group may have begun in another task.
                    high_first = int(begins[1])
                    group = _Group(keys[0].as_py(), min_docs, undecided=True)
                    group.add(batch.slice(0, high_first), new_id[:high_first], out)
                    group.close(out)
                    low, first = high_first, False
                if low < high:
                    # Groups that lie inside the batch, all at once.
                    inside = slice(low, high)
                    starts = begins[(begins >= low) & (begins < high)]
                    seen = np.cumsum(new_id[inside])
                    sizes = np.diff(np.append(starts, high))
                    nth = seen - np.repeat(seen[starts - low] - 1, sizes)
                    total = np.repeat(np.maximum.reduceat(nth, starts - low), sizes)
                    gone = (total >= min_docs) & (nth > 1)
                    if gone.any():
                        out.append(_marked(batch.slice(low, high - low).filter(pa.array(gone)), _DROP))
                group = _Group(keys[high].as_py(), min_docs, undecided=first)
                group.add(batch.slice(high), new_id[high:], out)
            if out:
                yield _joined(out)
        if group is not None:
            out = []
            group.end(out, schema)
            yield _joined(out)

    return read


class _Group:
    """A group of equal lines that batches, or the ends of a task, cut."""

    def __init__(self, key: bytes, min_docs: int, undecided: bool) -> None:
        self.key, self.min_docs, self.undecided = key, min_docs, undecided
        self.seen, self.first_ids, self.last_id = 0, [], None
        self.held: list[pa.RecordBatch] = []
        self.held_rows = 0

    def add(self, rows: pa.RecordBatch, new_id: np.ndarray, out: list[pa.RecordBatch]) -> None:
        ids = rows.column("id")
        fresh = new_id.copy()
        fresh[0] = self.seen == 0 or ids[0].as_py() != self.last_id
        nth = self.seen + np.cumsum(fresh)
        for at in np.flatnonzero(fresh)[: max(self.min_docs - len(self.first_ids), 0)]:
            self.first_ids.append(ids[int(at)].as_py())
        self.seen, self.last_id = int(nth[-1]), ids[len(ids) - 1].as_py()
        self._schema = rows.schema
        if self.undecided:
            out.append(_marked(rows, _OPEN))
            return
        early = int(np.searchsorted(nth, self.min_docs))  # rows of the documents before the decisive one
        if early:
            self.held.append(rows.slice(0, early))
            self.held_rows += early
        if self.seen >= self.min_docs:
            # Held rows but those of the first document, and all later ones, go.
            out.extend(_marked(_not_of(part, self.first_ids[0]), _DROP) for part in self.held)
            self.held, self.held_rows = [], 0
            out.append(_marked(rows.slice(early), _DROP))
        elif self.held_rows > _HELD_ROWS:
            self.undecided = True
            self._release(out)

    def _release(self, out: list[pa.RecordBatch]) -> None:
        out.extend(_marked(part, _OPEN) for part in self.held)
        self.held, self.held_rows = [], 0

    def close(self, out: list[pa.RecordBatch]) -> None:
        """The group ended inside the task."""
        if self.undecided:
            self.end(out, self._schema)

    def end(self, out: list[pa.RecordBatch], schema: pa.Schema) -> None:
        """What the merge has to know about the group."""
        self._release(out)
        count = len(self.first_ids)
        columns = [
            pa.array([self.key] * count, schema.field("key").type),
            pa.array(self.first_ids, schema.field("id").type),
            pa.nulls(count, schema.field("doc").type),
            pa.nulls(count, schema.field("lines").type),
        ]
        out.append(_marked(pa.RecordBatch.from_arrays(columns, ["key", "id", "doc", "lines"]), _EDGE))


def _marked(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    kinds = pa.array(np.full(rows.num_rows, kind, np.int32))
    return pa.RecordBatch.from_arrays([kinds, *rows.columns], ["kind", *rows.schema.names])


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of several: many small ones would cost more than their rows."""
    table = pa.Table.from_batches(parts).combine_chunks()
    return table.to_batches()[0] if table.num_rows else parts[0]


def _not_of(rows: pa.RecordBatch, first) -> pa.RecordBatch:
    ids = rows.column("id")
    same = pc.is_null(ids) if first is None else pc.fill_null(pc.equal(ids, pa.scalar(first, ids.type)), False)
    return rows.filter(pc.invert(same))


def _bitmaps(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """From lists of dropped lines to compressed bits: 1 stays; lines past the last bit stay."""
    for dropped in lists:
        packed = []
        for lines in dropped.to_pylist():
            keep = np.ones(max(lines) // 8 * 8 + 8, bool)
            keep[lines] = False
            packed.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6))
        yield pa.array(packed, pa.binary())


_bitmaps.__annotations__ = {"lists": Iterator[pa.Array], "return": Iterator[pa.Array]}


def kept_bits(bitmap: bytes | None, lines: int) -> np.ndarray:
    """Which of a document's ``lines`` lines stay."""
    keep = np.ones(lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:lines]
        keep[: len(bits)] = bits == 1
    return keep


_CUT = pa.struct([("n_dropped", pa.int64()), ("kept", pa.binary())])


def _cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, bitmaps in batches:
        rows = []
        for text, bitmap in zip(texts.cast(pa.binary()).to_pylist(), bitmaps.to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            keep = kept_bits(bitmap, len(lines))
            stay = [lines[at] for at in np.flatnonzero(keep)]
            rows.append({"n_dropped": len(lines) - len(stay), "kept": b"\n".join(stay)})
        yield pa.array(rows, _CUT)


_cut.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def line_bitmaps(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``id, doc, bitmap``: the documents that lose lines, each with a compressed bitmap of those that stay.

    ``doc`` is a key of the text.  A line's key is the line without ASCII blanks at its ends and A-Z in lower
    case.  Keys of at least ``min_chars`` code points that ``min_docs`` documents or more hold lose all
    their lines but those in the largest id.  Rows of one id are one document; NULL is an id of its own and the
    smallest.  NULL and empty texts have one empty line, which stays.  No rows: no rows.
    """
    bounded_batches(docs.sparkSession)
    lines = docs.select(
        col(id_column).alias("id"),
        text_key(col(text_column)).alias("doc"),
        F.explode(_line_keys(min_chars)(col(text_column))).alias("line"),
    ).select("line.key", "id", "doc", "line.lines")
    order = [F.asc("key"), F.desc_nulls_last("id"), F.asc("doc")]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = lines.schema["id"].dataType.simpleString()
    found = written(
        ordered.mapInArrow(_streamed(min_docs), f"kind int, key binary, id {kind}, doc bigint, lines array<int>"),
        "lines",
    )

    # At most ``min_docs`` ids for each end of a task decide the groups that it cut.
    edges = written(
        found.filter(F.col("kind") == _EDGE)
        .groupBy("key")
        .agg(
            F.max("id").alias("largest"),
            (F.size(F.collect_set("id")) + F.max(F.col("id").isNull().cast("int"))).alias("n"),
        )
        .filter(F.col("n") >= min_docs)
        .select("key", "largest"),
        "edges",
    )
    cut = found.filter(F.col("kind") == _OPEN).join(small(edges, 64), "key")
    cut = cut.filter(~F.col("id").eqNullSafe(F.col("largest"))).select("id", "doc", "lines")
    gone = found.filter(F.col("kind") == _DROP).select("id", "doc", "lines").union(cut)
    # A set: repeated rows of one document are combined before the shuffle.
    each = gone.groupBy("id", "doc").agg(F.flatten(F.collect_set("lines")).alias("dropped"))
    return each.select("id", "doc", F.arrow_udf(_bitmaps, "binary")("dropped").alias("bitmap"))


def without_repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``, the lines that stay, joined by a newline.

    See ``line_bitmaps``.  A column that has one of the new names is replaced.  No rows: no rows.
    """
    new = ("n_lines", "n_dropped", "kept_text")
    names = [name for name in docs.columns if name.lower() not in new]
    bitmaps = written(line_bitmaps(docs, id_column, text_column, min_chars, min_docs), "bitmaps")
    bitmaps = bitmaps.withColumnsRenamed({"id": "_id", "doc": "_doc"})
    text = F.coalesce(col(text_column), F.lit(""))
    keyed = docs.select(
        col(id_column).alias("id"),
        text_key(col(text_column)).alias("doc"),
        F.struct(*[col(name) for name in names]).alias("row"),
        text.alias("body"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("doc") == F.col("_doc"))
    touched = small(bitmaps.select("_id", "_doc"), 24)
    hit = keyed.join(touched, same, "left_semi").join(bitmaps, same)
    cut = F.arrow_udf(_cut, "struct<n_dropped:bigint,kept:binary>")
    hit = hit.select("row", "n_lines", cut("body", "bitmap").alias("cut")).select(
        "row", "n_lines", "cut.n_dropped", F.col("cut.kept").cast("string").alias("kept_text")
    )
    free = keyed.join(touched, same, "left_anti").select(
        "row", "n_lines", F.lit(0).cast("bigint").alias("n_dropped"), F.col("body").alias("kept_text")
    )
    return hit.union(free).select(*[F.col("row")[name].alias(name) for name in names], *new)
