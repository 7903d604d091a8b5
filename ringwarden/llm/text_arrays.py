"""Whole Arrow text columns as byte arrays: words, lines and their hashes without a loop per row.

Words are runs of bytes other than the ASCII white space 0x20 and 0x09-0x0D, as in
``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit polynomials over random byte values, taken from
prefix sums, so that any stretch of bytes costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at once in a task; the arrays take some 60 times that.
CHUNK_BYTES = 1 << 20
# The hash's base and the seeds of its byte values.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit over all others (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_EXACT = mix(np.arange(256, dtype=np.uint64))
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(off) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        _, off = utf8(batch.column(text))
        row, n = 0, batch.num_rows
        while row < n:
            end = max(row + 1, int(np.searchsorted(off, off[row] + limit, side="right")) - 1)
            yield batch.slice(row, end - row)
            row = end


@dataclass
class Texts:
    """One chunk of texts: bytes, row offsets, and what is derived from them."""

    data: np.ndarray
    off: np.ndarray
    fold: bool = False

    @classmethod
    def of(cls, column: pa.Array, fold: bool = False) -> Texts:
        """``fold``: the hashes do not tell ASCII capitals from small letters."""
        return cls(*utf8(column), fold)

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the runs of true bytes, cut where a row ends."""
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cut = np.unique(self.off[1:-1])
        cut = cut[(cut > 0) & (cut < len(inside))]
        cut = cut[inside[cut - 1] & inside[cut]]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        return starts, ends

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, positions, side="right") - 1

    @cached_property
    def solid(self) -> np.ndarray:
        return ~_SPACE[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(self.solid)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the non-empty stretches between newlines."""
        return self.runs(self.data != 0x0A)

    @cached_property
    def word_row(self) -> np.ndarray:
        return self.row_of(self.words[0])

    @cached_property
    def _prefix(self) -> np.ndarray:
        powers, _ = _power_tables(len(self.data))
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_FOLDED if self.fold else _EXACT)[self.data] * powers[: len(self.data)], out=out[1:])
        return out

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, inverse = _power_tables(len(self.data))
        sums = (self._prefix[ends] - self._prefix[starts]) * inverse[starts]
        return mix(sums + (ends - starts).astype(np.uint64))

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.hash(*self.words)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``size`` words within one row."""
        first = np.arange(max(0, len(self.word_hash) - size + 1))
        first = first[self.word_row[first] == self.word_row[first + size - 1]]
        h = np.zeros(len(first), np.uint64)
        for k in range(size):
            h = h * np.uint64(BASE) + self.word_hash[first + k]
        return first, mix(h)

    def per_row(self, rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(rows, weights, self.n).astype(np.int64)
