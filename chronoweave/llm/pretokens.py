"""Splitting texts into the pretokens of a byte-level BPE, without a regex.

The split is that of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.  The boundaries in a whole batch of texts
are found at once from an array of character classes; each distinct pretoken
is encoded once and found again by a 128-bit hash.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

from chronoweave.llm import vector_text as vt

OTHER, LETTER, NUMBER, BLANK, SPACE = 0, 1, 2, 3, 4  # BLANK is U+0020 alone
#: Code points of Unicode's White_Space property.
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
CHUNK = 500_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE] = SPACE
    table[32] = BLANK
    return table


def starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pretokens begin; ``offsets``: n + 1 bounds of the texts, none empty."""
    n = len(points)
    c = classes()[points]
    white = c >= BLANK
    start = np.empty(n, bool)
    # A run of one class begins a pretoken, unless a blank before it is its first character.
    np.logical_and(c[1:] != c[:-1], c[:-1] != BLANK, out=start[1:])
    # White space: the first of a run, and the last one if a word of the same text follows.
    start[1:][white[1:]] = False
    start[1:] |= white[1:] & ~white[:-1]
    start[:-1] |= white[:-1] & ~white[1:]
    first, last = offsets[:-1], offsets[1:] - 1
    ends = last[(last > first) & white[last]]
    ends = ends[white[ends - 1]]
    start[ends] = False
    start[first] = True
    after = ends[ends + 1 < n] + 1
    start[after] = True
    # Contractions count only where the apostrophe begins a pretoken.
    at = np.flatnonzero((points == 39) & start)
    if len(at):
        bound = offsets[np.searchsorted(offsets, at, "right")]
        padded = np.concatenate([points[-1:] * 0, [0, 0]]).astype(points.dtype)
        ahead = np.concatenate([points, padded])
        one = np.where(at + 1 < bound, ahead[at + 1], 0)
        two = np.where(at + 2 < bound, ahead[at + 2], 0)
        is_ = lambda x, s: np.isin(x, [ord(ch) for ch in s])
        pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))  # re ve ll
        size = np.where(is_(one, "stmd"), 2, np.where(pair, 3, 0))
        at, size, bound = at[size > 0], size[size > 0], bound[size > 0]
        start[at + 1] = False
        start[at[size == 3] + 2] = False
        follow = at + size
        start[follow[follow < bound]] = True
    return start


class Pieces:
    """Distinct pretokens of a worker and their ids; bounded in entries."""

    def __init__(self, encode: Callable[[str], list[int]], most: int = 800_000) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.table = vt.HashTable()
        self.check = np.empty(0, np.uint64)
        self.bounds = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def rows(self, text: str, a: np.ndarray, b: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The table's rows of pretokens text[a:b]; new ones are encoded."""
        back, distinct = pd.factorize(keys)
        order = np.argsort(distinct)
        distinct = distinct[order]
        row = self.table.find(distinct)
        new = np.flatnonzero(row < 0)
        if len(new):
            if self.table.size and self.table.size + len(new) > self.most:
                self.clear()
                return self.rows(text, a, b, keys, checks)
            where = np.empty(len(distinct), np.int64)
            where[back[::-1]] = np.arange(len(keys) - 1, -1, -1)  # the first place of each, in order of appearance
            w = where[order[new]]
            found = [self.encode(text[i:j]) for i, j in zip(a[w].tolist(), b[w].tolist())]
            row[new] = np.arange(self.table.size, self.table.size + len(new))
            self.table.add(distinct[new])
            self.check = np.concatenate([self.check, checks[w]])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in found])])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, self.bounds[-1] - len(self.ids))])
        by_appearance = np.empty(len(distinct), np.int64)
        by_appearance[order] = row
        row = by_appearance[back]
        if (self.check[row] != checks).any():
            raise ArithmeticError("two pretokens share a 64-bit hash")
        return row


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def encode_texts(texts: list[str], pieces: Pieces, special: dict[str, int]) -> Iterator[np.ndarray]:
    """The uint32 ids of each text; texts of special tokens become their ids."""
    marked = {i for s in special for i, t in enumerate(texts) if s in t}
    plain = [t if i not in marked else "" for i, t in enumerate(texts)] if marked else texts
    for at, to in _chunks(plain):
        sizes = np.fromiter(map(len, plain[at:to]), np.int64, to - at)
        full = np.flatnonzero(sizes)
        ids, bounds = np.empty(0, np.uint32), np.zeros(to - at + 1, np.int64)
        if len(full):
            big = "".join(plain[at:to])
            points = np.frombuffer(big.encode("utf-32-le"), np.uint32)
            offsets = np.concatenate([[0], np.cumsum(sizes[full])])
            a = np.flatnonzero(starts(points, offsets))
            b = np.append(a[1:], len(points))
            ranges = vt.of_symbols(points)
            keys = ranges.hash(a, b)
            low = vt.Ranges(((points + np.uint32(1)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA0761D6478BD642F))
            row = pieces.rows(big, a, b, keys, low.hash(a, b))
            size = pieces.bounds[row + 1] - pieces.bounds[row]
            ends = np.cumsum(size)
            where = np.repeat(pieces.bounds[row] - (ends - size), size)
            where += np.arange(where.size)
            ids = pieces.ids[where]
            total = np.concatenate([[0], ends])
            bounds[1:] = total[np.searchsorted(a, np.cumsum(sizes))]
        for i in range(to - at):
            if at + i in marked:
                yield _with_special(texts[at + i], pieces, special)
            else:
                yield ids[bounds[i] : bounds[i + 1]]


def _with_special(text: str, pieces: Pieces, special: dict[str, int]) -> np.ndarray:
    """Cut at special tokens, leftmost first and of these the longest."""
    out, at = [], 0
    while True:
        found = min(((p, -len(s), s) for s in special if (p := text.find(s, at)) >= 0), default=None)
        end = found[0] if found else len(text)
        out.extend(encode_texts([text[at:end]], pieces, {}))
        if not found:
            return np.concatenate(out)
        out.append(np.asarray([special[found[2]]], np.uint32))
        at = end + len(found[2])
