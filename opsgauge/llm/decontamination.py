"""Benchmark decontamination with one Aho-Corasick automaton over words.

The windows of all benchmark items form one automaton; each document is normalised and
scanned once, whatever the number of items.  Hits are word places, mapped back to
characters of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.llm.shared import bounded_batches, col, fresh, worker_cache

WINDOW_WORDS = 10
# Benchmark text in one automaton; a larger benchmark is scanned for in blocks.
BLOCK_BYTES = 4 * 1024**2

# In UTF-8, bytes from 0x80 on belong to characters that are not ASCII: all are word characters.
_NORMAL = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte >= 128 else 32
    for byte in range(256)
)
_WORD = re.compile(rb"[^\x20]+")

_HITS = (
    "struct<n_words:bigint,n_hit:bigint,items:array<string>,"
    "firsts:array<bigint>,lasts:array<bigint>,starts:array<bigint>,ends:array<bigint>>"
)
_HITS_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        *[(name, pa.list_(pa.int64())) for name in ("firsts", "lasts", "starts", "ends")],
    ]
)


def normal_words(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words: ASCII letters, digits and all characters that are not ASCII."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_NORMAL).split()


def windows_of(items: list[tuple], length: int) -> dict[tuple[bytes, ...], list[str]]:
    """Each window of the items' words, with the ids of the items it occurs in.

    An item of fewer words than ``length`` is one window, one without words is none.
    """
    found: dict[tuple[bytes, ...], set] = defaultdict(set)
    for item, text in items:
        parts = normal_words(text)
        if parts:
            for at in range(max(len(parts) - length, 0) + 1):
                own = found[tuple(parts[at : at + length])]
                if item is not None:
                    own.add(str(item))
    return {window: sorted(ids) for window, ids in found.items()}


def automaton(windows: list[tuple[tuple[bytes, ...], list[str]]]) -> tuple:
    """The numbers of the windows' words, and the automaton over these numbers."""
    numbers: dict[bytes, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, ids in windows:
        machine.add_word(tuple(numbers.setdefault(word, len(numbers) + 1) for word in window), (len(window), ids))
    if not windows:
        return numbers, None
    machine.make_automaton()
    return numbers, machine


def scan(text: bytes | None, numbers: dict[bytes, int], machine, before: dict | None = None) -> dict:
    """What of one text is hit, together with what was hit ``before`` by other windows.

    Runs of hit words are given by their first and last word, and by their start and end
    in characters of the original text.
    """
    raw = text or b""
    normal = raw.translate(_NORMAL)
    parts = normal.split()
    items: set[str] = set(before["items"]) if before else set()
    places = [list(run) for run in zip(before["firsts"], before["lasts"], strict=True)] if before else []
    if machine is not None and parts:
        number = numbers.get
        for last, (length, ids) in machine.iter(tuple([number(word, 0) for word in parts])):
            items.update(ids)
            first = last - length + 1
            # Ends ascend here, so a window can only join or swallow the latest runs.
            while places and not before and first <= places[-1][1] + 1:
                first = min(first, places.pop()[0])
            places.append([first, last])
    runs: list[list[int]] = []
    for first, last in sorted(places):
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    starts, ends = [], []
    if runs:
        spans = [match.span() for match in _WORD.finditer(normal)]
        # A character's first byte is any that does not continue one.
        characters = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        starts = [int(characters[spans[first][0]]) for first, _ in runs]
        ends = [int(characters[spans[last][1]]) for _, last in runs]
    return {
        "n_words": len(parts),
        "n_hit": sum(last - first + 1 for first, last in runs),
        "items": sorted(items),
        "firsts": [first for first, _ in runs],
        "lasts": [last for _, last in runs],
        "starts": starts,
        "ends": ends,
    }


def _kept_automaton(query: str, block: int, windows) -> tuple:
    """The automaton of a block, made once in a worker, which keeps those of one query only."""
    cache = worker_cache()
    if cache.get("windows", ("", {}))[0] != query:
        cache["windows"] = (query, {})
    blocks = cache["windows"][1]
    if block not in blocks:
        blocks[block] = automaton(windows.value)
    return blocks[block]


def _scanner(query: str, block: int, windows):
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        numbers, machine = _kept_automaton(query, block, windows)
        for texts, before in batches:
            raw = texts.cast(pa.binary()).to_pylist()
            yield pa.array(
                [scan(text, numbers, machine, old) for text, old in zip(raw, before.to_pylist(), strict=True)],
                _HITS_ARROW,
            )

    read.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(read, _HITS)


def _blocks(items: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in lists of about ``block_bytes`` of text; the driver holds one at a time."""
    block, size = [], 0
    rows = items.select(col(id_column), col(text_column)).filter(col(text_column).isNotNull())
    for row in rows.toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
    name: str = "contamination",
) -> DataFrame:
    """``docs`` with a column ``name``: ``n_words, n_hit, items, spans`` of each row.

    ``n_hit`` words of the text lie inside an occurrence of a benchmark window, ``items`` are
    the ids (as strings, sorted) of the items with an occurring window, ``spans`` the hit
    stretches as ``start, end`` characters of the original text.

    The benchmark is broadcast in blocks of a bounded size, each scanned for in the same pass over the
    rows.  NULL and empty texts have no words and no hits; items without words are ignored; an item
    without an id marks words but is not listed; repeated items count once.  An empty benchmark
    hits nothing.  Other columns are kept, an existing column ``name`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    [hits] = fresh(docs.columns, "hits")
    out = docs.withColumn(hits, F.lit(None).cast(_HITS))
    query = uuid.uuid4().hex
    for number, block in enumerate(_blocks(benchmark, item_column, item_text_column, block_bytes)):
        sent = context.broadcast(sorted(windows_of(block, window).items()))
        scanner = _scanner(query, number, sent)
        out = out.withColumn(hits, scanner(col(text_column), col(hits)))
    h = col(hits)
    spans = F.arrays_zip(h["starts"].alias("start"), h["ends"].alias("end"))
    found = F.struct(h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), h["items"].alias("items"), spans.alias("spans"))
    return out.withColumn(name, found).drop(hits)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark window occurs, columns unchanged."""
    [name] = fresh(docs.columns, "contamination")
    marked = contamination(docs, benchmark, name=name, **options)
    return marked.filter(col(name)["n_hit"] == 0).drop(name)
