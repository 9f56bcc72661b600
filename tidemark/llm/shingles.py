"""Word shingles of whole texts as 64-bit values, with numpy over an Arrow batch.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. Words
get a polynomial value over their bytes, shingles one over their words, both
finished with a bit mixer, so the values are even over 64 bits. Nothing here
knows Spark: callers run these helpers inside ``mapInArrow`` tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # text bytes that are handled at once; a longer text goes alone

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += _U(32)
    return space, mix((lower + _U(1)) * _U(0x9E3779B97F4A7C15))


_SPACE, _VALUE = _byte_tables()
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, _U(base), dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of all words in order, word counts before each text and in all).

    data: UTF-8 bytes of the texts one after the other; offsets: their ends, from 0.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~(inside[1:] & ~first[1:])
    ends = np.flatnonzero(last) + 1
    power, inverse = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.where(inside, _VALUE[data], _U(0)) * power, out=sums[1:])
    values = mix((sums[ends] - sums[starts]) * inverse[starts])
    return values, np.searchsorted(starts, offsets, side="left")


def shingles(values: np.ndarray, size: int) -> np.ndarray:
    """Values of all runs of ``size`` words; of the whole sequence if it is shorter; none of no words."""
    n = len(values)
    if not n:
        return values
    width = min(n, size)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = out * _U(_BASE) + values[k : n - width + 1 + k]
    return mix(out + _U(width))


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, bytes, offsets from 0) for chunks of about CHUNK_BYTES; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    rows = len(column)
    if not rows:
        return
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64, rows + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, side="right")) - 1)
        yield at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def word_values(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, values of its words in order) for each row."""
    for at, data, offsets in texts(column):
        values, bounds = words(data, offsets)
        for k in range(len(offsets) - 1):
            yield at + k, values[bounds[k] : bounds[k + 1]]


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct shingles) for each row."""
    for row, values in word_values(column):
        yield row, np.unique(shingles(values, size))
