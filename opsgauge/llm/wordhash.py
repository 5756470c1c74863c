"""Hashes of the words of Arrow string columns, computed over whole batches.

A word's hash is a sum over its bytes of (random value of the byte) x (random odd
value of its place), so it is summed piece by piece, in memory bounded by a
piece; runs of words are sums of word hashes in the same way.  All values come
from fixed seeds: every executor and every run agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_PIECE = 1 << 20
_PLACES = 1 << 12
_CHUNK_BYTES = 1 << 21


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_values(seed: int, count: int) -> np.ndarray:
    """``count`` fixed pseudo-random 64-bit values."""
    steps = np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 32)
    return mixed(steps * np.uint64(0x9E3779B97F4A7C15))


_PLACE = random_values(2, _PLACES) | np.uint64(1)


def byte_values(lower: bool) -> np.ndarray:
    """Random values of bytes; blanks are 0; A-Z like a-z if ``lower``."""
    table = random_values(1, 256)
    if lower:
        table[65:91] = table[97:123]
    table[[32, 9, 10, 11, 12, 13]] = 0
    return table


EXACT, LOWER = byte_values(False), byte_values(True)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; NULL rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, rows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``data``, and the index of each row's first word (one more at the end)."""
    solid = table[data] != 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inside = rows[:-1][rows[:-1] < len(data)]
    begins[inside] = solid[inside]
    starts = np.flatnonzero(begins)
    hashes = np.zeros(len(starts), np.uint64)
    for low in range(int(starts[0]) if len(starts) else len(data), len(data), _PIECE):
        high = min(low + _PIECE, len(data))
        first = int(np.searchsorted(starts, low, "right")) - 1
        last = int(np.searchsorted(starts, high, "left"))
        own = starts[first:last]
        cuts = np.maximum(own, low) - low
        place = np.arange(low, high) - np.repeat(own, np.diff(np.append(cuts, high - low)))
        values = table[data[low:high]] * _PLACE[place & (_PLACES - 1)]
        far = place >= _PLACES
        if far.any():
            values[far] *= mixed((place[far] // _PLACES).astype(np.uint64)) | np.uint64(1)
        hashes[first:last] += np.add.reduceat(values, cuts)
    return mixed(hashes), np.searchsorted(starts, rows)


def chunks(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a column some megabytes at a time: first row, end row, word hashes, first words.

    A row is never divided, whatever its length.
    """
    data, rows = _buffers(column)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(rows, rows[low] + _CHUNK_BYTES, "right")) - 1
        high = min(max(high, low + 1), len(column))
        part = rows[low : high + 1] - rows[low]
        hashes, firsts = words(data[rows[low] : rows[high]], part, table)
        yield low, high, hashes, firsts
        low = high


def windows(hashes: np.ndarray, length: int, seed: int = 3) -> np.ndarray:
    """Hashes of every ``length`` consecutive values, across rows too."""
    factors = random_values(seed, length) | np.uint64(1)
    count = max(len(hashes) - length + 1, 0)
    total = np.zeros(count, np.uint64)
    for at in range(length):
        total += hashes[at : at + count] * factors[at]
    return mixed(total)
