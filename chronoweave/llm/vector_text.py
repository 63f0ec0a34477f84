"""Vectorised text kernels: many texts of an Arrow column at once.

Texts of a batch lie behind one another in one array of bytes (or code
points).  Words and pretokens are index ranges into it; a polynomial hash of
any range is the difference of two prefix sums.  No Python string is made for
a word, so a core handles tens of MB a second.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: ASCII white space of the word rules.
WHITE = b"\t\n\x0b\x0c\r "


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=_U) * _U(_BASE))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    if _powers.get("n", 0) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


class Ranges:
    """Hashes of index ranges of an array of symbols."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = powers(len(values) + 1)
        self.sums = np.empty(len(values) + 1, _U)
        self.sums[0] = 0
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U) * _M2)


def of_symbols(symbols: np.ndarray) -> Ranges:
    """Of bytes or code points."""
    return Ranges(_symbols()[symbols])


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them; null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, where, data = col.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or not len(col):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


@lru_cache(maxsize=8)
def byte_table(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """is-word and lower-case tables over bytes."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return word, fold


class Words:
    """The words of a string column.

    ``data``: bytes, lower-cased in A-Z if asked; ``start``, ``end``: ranges of
    words; ``first``: n + 1 indices, the words of text i are first[i]:first[i+1].
    """

    def __init__(self, col: pa.Array, separators: bytes = WHITE, lower: bool = True) -> None:
        raw, self.offsets = column_bytes(col)
        word, fold = byte_table(separators, lower)
        self.raw, self.data = raw, fold[raw] if lower else raw
        begins = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        n = len(raw)
        if n:
            inside = word[raw]
            start = inside.copy()
            start[1:] &= ~inside[:-1]
            start[begins] = inside[begins]
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            last[begins[1:] - 1] = inside[begins[1:] - 1]
            self.start, self.end = np.flatnonzero(start), np.flatnonzero(last) + 1
        else:
            self.start = self.end = np.empty(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return of_symbols(self.data).hash(self.start, self.end)

    def text_of(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with one blank after each: bytes, starts and ends."""
        size = self.end - self.start + 1
        ends = np.cumsum(size)
        starts = ends - size
        where = np.repeat(self.start - starts, size)
        where += np.arange(where.size)
        if where.size:
            where[-1] = min(where[-1], len(self.data) - 1)
            where = np.minimum(where, len(self.data) - 1)
        out = self.data[where]
        out[ends - 1] = 32
        return out, starts, ends - 1


def word_hash(word: bytes) -> int:
    """The hash that ``Words.hashes`` gives a word."""
    if not word:
        return 0
    return int(of_symbols(np.frombuffer(word, np.uint8)).hash(np.zeros(1, np.int64), np.full(1, len(word)))[0])


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]] along axis 0; empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.result_type(values.dtype, np.int64))
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class HashTable:
    """64-bit keys to row numbers, in sorted order; grows by merging."""

    def __init__(self) -> None:
        self.keys, self.rows, self.size = np.empty(0, _U), np.empty(0, np.int64), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1.  Sorted queries are the fastest."""
        if not self.size:
            return np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == self.size] = 0
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def add(self, keys: np.ndarray) -> None:
        """New sorted distinct keys get the next row numbers."""
        at = np.searchsorted(self.keys, keys)
        self.rows = np.insert(self.rows, at, np.arange(self.size, self.size + len(keys)))
        self.keys = np.insert(self.keys, at, keys)
        self.size = len(self.keys)
