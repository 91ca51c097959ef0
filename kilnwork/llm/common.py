"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources.shared import written  # noqa: F401  (the operators take it from here)

#: Bytes of text that numpy works on at a time; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random 64-bit value for each byte, the same in every process.
BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=U64)
#: Powers of the base and of its inverse modulo 2**64, grown when a longer block comes.
_powers = [np.ones(1, U64), np.ones(1, U64)]


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that others, of whatever name, don't matter."""
    return df.select(*[df[c] for c in columns])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * n + 1, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


class Rolling:
    """Polynomial prefix sums modulo 2**64: the hash of any stretch of symbols, wherever it lies, in constant time."""

    def __init__(self, symbols: np.ndarray):
        power, self.inverse = _powers_to(len(symbols))
        self.sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * power[: len(symbols)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of a string column as UTF-8: (first row, rows, bytes, offsets). A null is empty; a block has at most `limit` bytes unless one row has more."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: Bytes of words by the rule [^\x20\x09-\x0D]+ .
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters and digits: every byte of [^\x00-\x2F\x3A-\x60\x7B-\x7F] (after A-Z is lower-cased).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document of each word): runs of the bytes that `kind` marks, none across a document's end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts + 1]
    ends[cuts - 1] = inside[cuts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_counts(documents: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(documents, minlength=n)


def per_document(documents: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by document."""
    return np.bincount(documents, values, n).astype(np.int64)
