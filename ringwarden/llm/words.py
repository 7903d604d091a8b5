"""Lower-case words of Arrow text columns as byte stretches, exact word tables and CRC-32 without a loop per word.

Words are runs of ASCII letters and digits and of all bytes from 0x80 on, with A-Z lower-cased, as in
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over text in which only A-Z were changed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from .text_arrays import Texts, mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
# Words of up to so many bytes are two 64-bit integers, which tell them apart exactly: no word holds a zero byte.
PACKED_BYTES = 16
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
# Bytes of a word that are taken side by side with those of other words; the rest goes through zlib.
_SIDE_BY_SIDE = 48

# The CRC-32 table from its polynomial.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


class Words:
    """All words of a chunk of texts: lower-case bytes, start, end and row of each."""

    def __init__(self, column: pa.Array):
        t = Texts.of(column)
        self.data = _LOWER[t.data]
        self.starts, self.ends = Texts(self.data, t.off).runs(_INSIDE[self.data])
        self.row = t.row_of(self.starts)
        self.n_rows = t.n

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two integers for each word and whether they hold all of it."""
        padded = np.concatenate([self.data, np.zeros(PACKED_BYTES, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        n = self.ends - self.starts
        low = eight[self.starts] & _MASK[np.minimum(n, 8)]
        high = eight[self.starts + 8] & _MASK[np.clip(n - 8, 0, 8)]
        return low, high, n <= PACKED_BYTES


class WordTable:
    """Numbers of the words of a list, looked up exactly; -1 for all others."""

    def __init__(self, words: list[bytes]):
        self.long = {w: i for i, w in enumerate(words) if len(w) > PACKED_BYTES}
        index = np.array([i for i, w in enumerate(words) if len(w) <= PACKED_BYTES], np.int64)
        both = b"".join(words[i].ljust(PACKED_BYTES, b"\0") for i in index.tolist())
        low, high = np.frombuffer(both, "<u8").reshape(-1, 2).T
        self.seed = np.uint64(0)
        while True:  # two words of one place are told apart by another seed
            place = mix(low ^ mix(high + self.seed))
            if len(np.unique(place)) == len(place):
                break
            self.seed += np.uint64(1)
        order = np.argsort(place)
        self.place, self.low, self.high, self.index = place[order], low[order], high[order], index[order]

    def find(self, words: Words) -> np.ndarray:
        out = np.full(len(words), -1, np.int64)
        low, high, whole = words.packed()
        if len(self.place):
            place = mix(low ^ mix(high + self.seed))
            at = np.minimum(np.searchsorted(self.place, place), len(self.place) - 1)
            hit = whole & (self.place[at] == place) & (self.low[at] == low) & (self.high[at] == high)
            out[hit] = self.index[at[hit]]
        if self.long:
            for k in np.flatnonzero(~whole).tolist():
                out[k] = self.long.get(words.bytes_of(k), -1)
        return out


def crc32(words: Words, which: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of the words ``which``; ``before``: CRC-32 of what each of them follows."""
    out = np.zeros(len(which), np.uint32)
    n = words.ends[which] - words.starts[which]
    order = np.argsort(-n, kind="stable")
    start, n = words.starts[which][order], n[order]
    state = np.full(len(which), 0xFFFFFFFF, np.uint32) if before is None else ~before[order].astype(np.uint32)
    steps = min(int(n.max(initial=0)), _SIDE_BY_SIDE)
    longer = len(n) - np.searchsorted(n[::-1], np.arange(steps), side="right")  # words with more than k bytes
    for k in range(steps):
        m = longer[k]
        head = state[:m]
        state[:m] = _CRC[(head ^ words.data[start[:m] + k]) & 0xFF] ^ (head >> 8)
    state = ~state
    for k in range(int((n > _SIDE_BY_SIDE).sum())):
        rest = words.data[start[k] + _SIDE_BY_SIDE : start[k] + n[k]].tobytes()
        state[k] = zlib.crc32(rest, int(state[k]))
    out[order] = state
    return out


def crc32_space(before: np.ndarray) -> np.ndarray:
    """CRC-32 after one more space."""
    state = ~before.astype(np.uint32)
    return ~(_CRC[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> 8))
