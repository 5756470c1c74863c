"""Alignment of two tokenizers over the same text, window by window.

A text is tokenised whole by both, and the byte offsets of all token ends are known.  Where both
have an end and both next tokens start with a blank, the text is cut: the windows between such
anchors are short, and what is linked in them depends on their token ids alone.  So a window's alignment is
computed once for each pair of id tuples that a worker meets and remembered.  A document keeps its different
id pairs as a packed list, from which pairs are counted over all documents and the counts are read back.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.llm.shared import bounded_batches, col, fresh, worker_cache, written
from opsgauge.llm.wordhash import mixed

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# The pattern that parts a text before the merges of the byte-level vocabulary: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Windows after which a worker forgets those it has met, and characters it aligns at once.
_MEMO_WINDOWS, _PART_CHARS = 200_000, 1_000_000
# A group with more links is counted by its different ids.
_LISTED_LINKS = 10_000
# Pairs whose counts are sent to every task at once: 16 bytes each.
PAIRS_PER_BLOCK = 2_000_000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(byte): byte for byte in plain}
    others = [byte for byte in range(256) if byte not in plain]
    letters.update({chr(256 + at): byte for at, byte in enumerate(others)})
    return letters


class Tokenizers:
    """Both tokenizers of a worker, with each id's bytes."""

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        import sentencepiece

        with open(byte_bpe, encoding="utf-8") as file:
            stored = json.load(file)
        model, letters = stored["model"], _byte_letters()
        # Never produced, as their strings are plain text.
        special = {token["content"] for token in stored["added_tokens"] if token["special"]}
        ranks = {bytes(letters[c] for c in token): at for token, at in model["vocab"].items() if token not in special}
        self._first = self._encoder(byte_bpe, model, ranks)
        self.first_bytes = self._table({at: token for token, at in ranks.items()})
        self._second = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        pieces = {}
        for at in range(self._second.get_piece_size()):
            piece = self._second.id_to_piece(at)
            pieces[at] = bytes([int(piece[3:5], 16)]) if self._second.is_byte(at) else piece.replace("▁", " ").encode()
        self.second_bytes = self._table(pieces)
        self.first_sizes, self.first_marked = self._shapes(self.first_bytes)
        self.second_sizes, self.second_marked = self._shapes(self.second_bytes)

    @staticmethod
    def _encoder(path: str, model: dict, ranks: dict[bytes, int]):
        """An encoder without special tokens.

        If merges are numbered in the order of their ids, merging by rank is the same and a few times faster.
        """
        vocab = model["vocab"]
        merges = ["".join(merge if isinstance(merge, list) else merge.split(" ")) for merge in model["merges"]]
        if [vocab.get(merge) for merge in merges] == list(range(256, 256 + len(merges))):
            import tiktoken

            return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _table(known: dict[int, bytes]) -> list[bytes]:
        return [known.get(at, b"") for at in range(max(known) + 1)]

    @staticmethod
    def _shapes(table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(token) for token in table]), np.array([token[:1] == b" " for token in table])

    def encode(self, text: str | None) -> tuple[list[int], list[int]] | None:
        """The ids of a text by both; None if it has none or if either does not give back the blank and the text."""
        if not text:
            return None
        spaced = " " + text
        first, second = self._first(spaced), self._second.encode(text)
        data = spaced.encode()
        if b"".join(map(self.first_bytes.__getitem__, first)) != data:
            return None
        return (first, second) if b"".join(map(self.second_bytes.__getitem__, second)) == data else None


def tokenizers(byte_bpe: str, piece_bpe: str) -> Tokenizers:
    """The tokenizers of this worker, read once."""
    cache, key = worker_cache(), f"tokenizers {byte_bpe} {piece_bpe}"
    if key not in cache:
        cache[key] = Tokenizers(byte_bpe, piece_bpe)
    return cache[key]


@dataclass
class Texts:
    """Tokenised texts one after the other: ids, the bytes until the end of each token, where each text begins."""

    first: np.ndarray
    second: np.ndarray
    ends: np.ndarray
    other_ends: np.ndarray
    texts: np.ndarray

    @classmethod
    def of(cls, ids: list[tuple[list[int], list[int]]], tok: Tokenizers) -> Texts:
        first = np.fromiter(chain.from_iterable(own for own, _ in ids), np.int64)
        second = np.fromiter(chain.from_iterable(other for _, other in ids), np.int64)
        ends, other_ends = np.cumsum(tok.first_sizes[first]), np.cumsum(tok.second_sizes[second])
        last = np.cumsum([len(own) for own, _ in ids]) - 1
        return cls(first, second, ends, other_ends, np.concatenate([[0], ends[last]]))


def anchors(texts: Texts, tok: Tokenizers) -> np.ndarray:
    """The byte offsets where windows begin, and the last end.

    Both tokenizers have a token end there, and both next tokens begin with a blank; texts end there too.
    """
    shared = _shared(texts.ends, texts.other_ends)
    after = np.searchsorted(texts.ends, shared[:-1], "right")
    other_after = np.searchsorted(texts.other_ends, shared[:-1], "right")
    marked = tok.first_marked[texts.first[after]] & tok.second_marked[texts.second[other_after]]
    marked[np.searchsorted(shared, texts.texts[1:-1])] = True
    return np.concatenate([[0], shared[:-1][marked], shared[-1:]])


def _shared(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The ends that both ascending lists have; the last one of both is the same."""
    both = ends[others[np.searchsorted(others, ends)] == ends]
    return both[np.append(True, both[1:] != both[:-1])]


def _inside(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    return keys[starts], np.add.reduceat(values[order], starts) if len(keys) else values


class Windows:
    """The windows that a worker has met, by the pair of their id tuples, with what is linked in them.

    Forgotten all at once when they are too many.
    """

    def __init__(self, tok: Tokenizers) -> None:
        self.tok = tok
        self.width = len(tok.second_sizes)
        decimals = [str(at) for at in range(max(len(tok.first_sizes), self.width))]
        # An id with what follows it: another of its group, the other side, the next group, nothing.
        self._pieces = [number + mark for mark in (",", "|", ";", "") for number in decimals]
        self._piece_sizes = np.array([len(piece) for piece in self._pieces])
        self._kinds = len(decimals)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[tuple[bytes, bytes], int] = {}
        self.shown: list[str] = []
        self.groups, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def number(self, texts: Texts, cuts: np.ndarray) -> np.ndarray:
        """The numbers of the windows between ``cuts``; unknown ones are aligned together."""
        if len(self.numbers) > _MEMO_WINDOWS:
            self.forget()
        begins = np.concatenate([[0], np.searchsorted(texts.ends, cuts[1:], "right")])
        other_begins = np.concatenate([[0], np.searchsorted(texts.other_ends, cuts[1:], "right")])
        own, other = texts.first.astype("<u4").tobytes(), texts.second.astype("<u4").tobytes()
        unknown: list[int] = []
        numbers, known = self.numbers, len(self.shown)
        edges, other_edges = (begins * 4).tolist(), (other_begins * 4).tolist()
        likes = _alike((texts.first, begins), (texts.second, other_begins))
        leaders = np.flatnonzero(likes == np.arange(len(likes)))
        found = np.zeros(len(likes), np.int64)
        for at in leaders.tolist():
            key = own[edges[at] : edges[at + 1]], other[other_edges[at] : other_edges[at + 1]]
            number = numbers.get(key)
            if number is None:
                number = numbers[key] = known + len(unknown)
                unknown.append(at)
            found[at] = number
        found = found[likes]
        if unknown:
            new = np.array(unknown)
            self._align(
                texts.first[_ranges(begins, new)],
                texts.second[_ranges(other_begins, new)],
                np.diff(cuts)[new],
            )
        return found

    def _align(self, first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> None:
        """Add windows of these ids and sizes in bytes, one after the other.

        A group ends where a token of each ends; each of its first tokens is linked with each of its second ones.
        """
        windows = np.cumsum(sizes)
        ends, other_ends = np.cumsum(self.tok.first_sizes[first]), np.cumsum(self.tok.second_sizes[second])
        shared = _shared(ends, other_ends)
        group, other_group = np.searchsorted(shared, ends), np.searchsorted(shared, other_ends)
        size, other_size = np.bincount(group, minlength=len(shared)), np.bincount(other_group, minlength=len(shared))
        window = np.searchsorted(windows, shared)
        count = len(sizes)

        self.groups = np.append(self.groups, np.bincount(window, minlength=count))
        self.links = np.append(self.links, np.bincount(window, size * other_size, minlength=count).astype(np.int64))
        self._show(first, second, group, other_group, shared, windows)

        begin, other_begin = np.cumsum(size) - size, np.cumsum(other_size) - other_size
        small = size * other_size <= _LISTED_LINKS
        links = np.where(small, size * other_size, 0)
        of, at = np.repeat(np.arange(len(shared)), links), _inside(links)
        codes = first[begin[of] + at // other_size[of]] * self.width + second[other_begin[of] + at % other_size[of]]
        windows_of, weights = window[of], np.ones(len(of), np.int64)
        parts = [(windows_of, codes, weights)]
        for big in np.flatnonzero(~small):
            # So many tokens without a common end: counted by their different ids.
            own, n = np.unique(first[begin[big] : begin[big] + size[big]], return_counts=True)
            other, m = np.unique(second[other_begin[big] : other_begin[big] + other_size[big]], return_counts=True)
            product = (own[:, None] * self.width + other[None, :]).ravel()
            parts.append((np.full(len(product), window[big]), product, (n[:, None] * m[None, :]).ravel()))
        windows_of, codes, weights = (np.concatenate(column) for column in zip(*parts, strict=True))
        top = len(self.tok.first_sizes) * self.width
        keys, counts = _summed(windows_of * top + codes, weights)
        per_window = np.bincount(keys // top, minlength=count)
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(per_window))
        self.codes, self.counts = np.append(self.codes, keys % top), np.append(self.counts, counts)

    def _show(self, first, second, group, other_group, shared, windows) -> None:
        """The groups of each window as text."""
        comma, bar, semicolon, nothing = (mark * self._kinds for mark in range(4))
        more = np.append(group[1:] == group[:-1], False)
        other_more = np.append(other_group[1:] == other_group[:-1], False)
        ends_window = np.isin(shared, windows)[other_group]
        after = np.where(other_more, comma, np.where(ends_window, nothing, semicolon))
        pieces = np.concatenate([first + np.where(more, comma, bar), second + after])
        order = np.argsort(np.concatenate([group * 2, other_group * 2 + 1]), kind="stable")
        pieces = pieces[order]
        joined = "".join(map(self._pieces.__getitem__, pieces.tolist()))
        owner = np.concatenate([np.searchsorted(windows, shared)[group], np.searchsorted(windows, shared)[other_group]])
        widths = np.bincount(owner[order], self._piece_sizes[pieces], minlength=len(windows)).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(widths)]).tolist()
        self.shown.extend(joined[cuts[at] : cuts[at + 1]] for at in range(len(windows)))


def _alike(*sides: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each window the first one with the same ids: found by a hash, then compared id by id."""
    count = len(sides[0][1]) - 1
    keys = np.zeros(count, np.uint64)
    for ids, begins in sides:
        sizes = np.diff(begins)
        spread = mixed(ids.astype(np.uint64) + (_inside(sizes).astype(np.uint64) << np.uint64(32)))
        keys = mixed(keys + np.add.reduceat(spread, begins[:-1]))
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    likes = np.zeros(count, np.int64)
    likes[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    for ids, begins in sides:
        same = np.array_equal(np.diff(begins)[likes], np.diff(begins))
        if not same or not np.array_equal(ids[_ranges(begins, likes)], ids):
            return np.arange(count)  # a collision: every window for itself
    return likes


def _ranges(begins: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The places from ``begins`` of each chosen one up to the next."""
    sizes = begins[chosen + 1] - begins[chosen]
    return np.repeat(begins[chosen], sizes) + _inside(sizes)


def packed(codes: np.ndarray, links: np.ndarray) -> bytes:
    """Ascending pair codes and their numbers of links, compressed."""
    steps = np.diff(codes, prepend=0)
    small = steps.max(initial=0) < 1 << 32 and links.max(initial=0) < 1 << 16
    kinds = ("<u4", "<u2") if small else ("<u8", "<u8")
    # Bytes of equal rank next to each other compress better.
    planes = [
        values.astype(kind).view(np.uint8).reshape(len(values), -1).T.tobytes()
        for values, kind in zip((steps, links), kinds, strict=True)
    ]
    return bytes([int(small)]) + zlib.compress(planes[0] + planes[1], 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The codes and links of ``packed``."""
    widths = (4, 2) if data[0] else (8, 8)
    raw = np.frombuffer(zlib.decompress(data[1:]), np.uint8)
    count = len(raw) // sum(widths)
    cut = count * widths[0]
    values = [
        np.ascontiguousarray(part.reshape(width, count).T).view(f"<u{width}").ravel().astype(np.int64)
        for part, width in zip((raw[:cut], raw[cut:]), widths, strict=True)
    ]
    return np.cumsum(values[0]), values[1]


_ALIGNED = pa.struct(
    [
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("pairs", pa.binary()),
    ]
)


_NOTHING = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": None}


def aligned_texts(texts: list[str | None], known: Windows) -> list[dict]:
    """The texts' counts, the digests of their groups and their packed pairs."""
    ids = [known.tok.encode(text) for text in texts]
    present = [at for at, found in enumerate(ids) if found is not None]
    rows = [_NOTHING] * len(texts)
    if not present:
        return rows
    tokenised = Texts.of([ids[at] for at in present], known.tok)
    cuts = anchors(tokenised, known.tok)
    window = known.number(tokenised, cuts)
    # Windows by text: no window crosses one.
    edges = np.searchsorted(cuts, tokenised.texts)
    text_of = np.repeat(np.arange(len(present)), np.diff(edges))
    groups, links = np.add.reduceat(known.groups[window], edges[:-1]), np.add.reduceat(known.links[window], edges[:-1])
    total = len(known.shown)
    met, times = _summed(text_of * total + window, np.ones(len(window), np.int64))
    owner, window_of = met // total, met % total
    sizes = known.starts[window_of + 1] - known.starts[window_of]
    place = np.repeat(known.starts[window_of], sizes) + _inside(sizes)
    top = len(known.tok.first_sizes) * known.width
    pairs, counts = _summed(np.repeat(owner, sizes) * top + known.codes[place], known.counts[place] * np.repeat(times, sizes))
    bounds = np.searchsorted(pairs, np.arange(len(present) + 1) * top).tolist()
    window, edges = window.tolist(), edges.tolist()
    for at, row in enumerate(present):
        shown = ";".join(map(known.shown.__getitem__, window[edges[at] : edges[at + 1]]))
        own = slice(bounds[at], bounds[at + 1])
        rows[row] = {
            "n_a": len(ids[row][0]),
            "n_b": len(ids[row][1]),
            "n_groups": int(groups[at]),
            "n_links": int(links[at]),
            "groups_sha256": hashlib.sha256(shown.encode()).hexdigest(),
            "pairs": packed(pairs[own] - at * top, counts[own]),
        }
    return rows


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in parts of bounded length; a longer one is a part of its own."""
    part, held = [], 0
    for text in texts:
        size = len(text or "")
        if part and held + size > _PART_CHARS:
            yield part
            part, held = [], 0
        part.append(text)
        held += size
    if part:
        yield part


def _aligner(byte_bpe: str, piece_bpe: str):
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Windows(tokenizers(byte_bpe, piece_bpe))
        for texts in batches:
            yield pa.array([row for part in _parts(texts.to_pylist()) for row in aligned_texts(part, known)], _ALIGNED)

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kinds = "n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,pairs:binary"
    return F.arrow_udf(read, f"struct<{kinds}>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a batch's documents each pair is linked."""
    for batch in batches:
        codes = [unpacked(data)[0] for data in batch.column(0).to_pylist() if data is not None]
        if codes:
            pairs, counts = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int64))], ["pair", "n"])


_SCORES = pa.struct([("n_best", pa.int64()), ("count_sum", pa.int64())])


def _scorer(block: Broadcast):
    """From packed pairs to the links of best pairs and the sum of counts, over the pairs of a block."""

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pairs, counts, best = block.value
        for column in batches:
            rows = []
            for data in column.to_pylist():
                n_best = count_sum = 0
                if data is not None and len(pairs):
                    codes, links = unpacked(data)
                    at = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
                    links = np.where(pairs[at] == codes, links, 0)
                    n_best, count_sum = int((links * best[at]).sum()), int((links * counts[at]).sum())
                rows.append({"n_best": n_best, "count_sum": count_sum})
            yield pa.array(rows, _SCORES)

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(read, "struct<n_best:bigint,count_sum:bigint>")


def align_tokens(
    docs: DataFrame,
    text_column: str = "text",
    folder: str = FOLDER,
    byte_bpe: str = BYTE_BPE,
    piece_bpe: str = PIECE_BPE,
    pairs_per_block: int = PAIRS_PER_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """``docs`` without the text, with what is aligned in it, and the table of linked id pairs.

    Both tokenizers read the text without special tokens, the first one after a blank, which the second adds
    itself.  New columns: ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``, ``groups_sha256``, ``pairs``
    (packed: see ``unpacked``), ``n_best`` (links whose pair is in as many documents as any pair of its first id,
    ties included) and ``count_sum`` (documents of the pair, over all links).  The table has ``first, second, n,
    best``; it is bounded by the vocabularies and sent to tasks in blocks of ``pairs_per_block``.  Texts that are
    NULL or empty, or that the tokens do not give back byte by byte, have zeros and an empty digest.  Every row is a
    document, repeated ones too.  A column that has one of the new names is replaced.  No rows: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    first_path, second_path = os.path.join(folder, byte_bpe), os.path.join(folder, piece_bpe)
    new = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "n_best", "count_sum")
    names = [name for name in docs.columns if name.lower() not in new and name != text_column]
    (row,) = fresh([*names, *new], "row")
    aligned = docs.select(
        *[col(name) for name in names], _aligner(first_path, second_path)(col(text_column)).alias("_aligned")
    )
    aligned = aligned.select(*[col(name) for name in names], "_aligned.*").withColumn(row, F.monotonically_increasing_id())
    aligned = written(aligned, "aligned")

    width = len(tokenizers(first_path, second_path).second_sizes)
    pairs = aligned.select("pairs").mapInArrow(_counted, "pair bigint, n bigint")
    pairs = written(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    first = F.floor(F.col("pair") / width) if width & (width - 1) else F.shiftright("pair", width.bit_length() - 1)
    pairs = pairs.withColumn("first", first.cast("bigint"))
    most = pairs.groupBy("first").agg(F.max("n").alias("most"))
    pairs = pairs.join(most, "first").select(
        "pair", "first", (F.col("pair") % width).alias("second"), "n", (F.col("n") == F.col("most")).alias("best")
    )
    pairs = written(pairs, "best_pairs")

    blocks = max(-(-pairs.count() // pairs_per_block), 1)
    parts = []
    for block in range(blocks):
        own = pairs.filter(F.pmod(F.hash("pair"), F.lit(blocks)) == block) if blocks > 1 else pairs
        table = own.select("pair", "n", "best").toArrow()
        values = [table.column(at).to_numpy() for at in range(3)]
        order = np.argsort(values[0])
        shared = spark.sparkContext.broadcast(tuple(column[order] for column in values))
        parts.append(aligned.withColumn("_score", _scorer(shared)("pairs")))
    if blocks == 1:
        (scored,) = parts
    else:
        sums = None
        for part in parts:
            narrow = written(part.select(row, "_score.*"), "scores")
            sums = narrow if sums is None else sums.union(narrow)
        sums = sums.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        scored = aligned.join(sums, row).withColumn("_score", F.struct("n_best", "count_sum"))
    result = scored.select(*[col(name) for name in [*names, *new[:6]]], "_score.n_best", "_score.count_sum")
    return result, pairs.select("first", "second", "n", "best")
