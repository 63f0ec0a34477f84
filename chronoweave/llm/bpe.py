"""BPE encoding and decoding with a public byte-level vocabulary.

*Encoding.*  Every pretoken is encoded by backtracking: an Aho-Corasick
automaton over all tokens yields, in one pass, the longest token at every
position; the encoder takes the longest one that is compatible with the token
before it, steps to shorter prefixes where the pair is not, and steps back
where no prefix is.  Two neighbouring tokens are compatible iff merging their
bytes by rank would leave exactly these two; the answer is kept in a table.
The result equals rank-ordered merging, in time linear in the text.

*Decoding.*  All tokens lie behind one another in one byte string; an offset
table turns an array of ids into an array of byte positions.

Null text counts as empty; an empty text has no ids.  Equal texts give equal
ids.  Extra input columns are ignored.  Repeated rows give repeated results;
an empty table gives no rows.  A very long text is encoded whole by one task,
whose memory follows its length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from chronoweave.llm.common import ddl, id_text, map_docs, worker_cache
from chronoweave.llm.pretokens import Pieces, encode_texts


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies.

    Bytes that print in Latin-1 stand for themselves; the others take the code
    points from 256 on, in ascending order.
    """
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b if b in prints else next(spare)): b for b in range(256)}


def load(path: str) -> tuple[dict[bytes, int], dict[str, int], list[tuple[bytes, bytes]]]:
    """Tokens, special tokens and merges of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    raw = lambda s: bytes(alphabet[ch] for ch in s)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    return {raw(s): i for s, i in spec["model"]["vocab"].items()}, {t["content"]: t["id"] for t in spec["added_tokens"]}, [(raw(a), raw(b)) for a, b in pairs]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        vocab, self.special, merges = load(path)
        size = max([*vocab.values(), *self.special.values()]) + 1
        token = [b""] * size
        for s, i in vocab.items():
            token[i] = s
        for s, i in self.special.items():
            token[i] = s.encode()
        self.size = np.fromiter(map(len, token), np.int64, size)
        self.offset = np.concatenate([[0], np.cumsum(self.size)])
        self.blob = np.frombuffer(b"".join(token), np.uint8)
        self.token, self.vocab = token, vocab
        self.made: dict[tuple[int, int], int] = {}  # pair -> merged token
        self.parts: dict[int, tuple[int, int]] = {}  # token -> the pair it was merged from
        for left, right in merges:
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            if whole not in self.parts:
                self.made[pair] = whole
                self.parts[whole] = pair
        self.trie = ahocorasick.Automaton()
        for s, i in vocab.items():
            self.trie.add_word(s.decode("latin-1"), i)
        self.trie.make_automaton()
        self.lengths = self.size.tolist()
        self.widest = max(map(len, vocab))
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.pieces = Pieces(self.encode_piece)

    def _prefix(self, t: int) -> int:
        """The longest token that is a proper prefix of token t, or -1."""
        if (p := self.shorter.get(t)) is None:
            s = self.token[t]
            p = self.shorter[t] = next((self.vocab[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.vocab), -1)
        return p

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank leaves exactly a, b.

        Walks back over the merges along the seam, latest first.  A seam pair
        that merges earlier than both sides were finished would have been
        taken, so the two tokens could not stand beside each other.
        """
        if (known := self.fits.get((a, b))) is not None:
            return known
        x, y, bound, good = a, b, 1 << 62, None
        while good is None:
            whole = self.made.get((x, y))
            if whole is not None and whole < bound:
                good = False
                break
            left, right = self.parts.get(x), self.parts.get(y)
            if left is None and right is None:
                good = True
            elif right is None or (left is not None and x > y):
                bound, x = x, left[1]  # x was made after y: undo x
            else:
                bound, y = y + 1, right[0]  # ties on the seam go to the left one
        if len(self.fits) < 500_000:
            self.fits[a, b] = good
        return good

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        whole = self.vocab.get(data)
        if whole is not None and self._self_encoded(whole):
            return [whole]
        n, lengths, latin = len(data), self.lengths, data.decode("latin-1")
        longest = {end + 1 - lengths[t]: t for end, t in self.trie.iter_long(latin)}  # leftmost-longest matches
        known, prefixes = self.fits.get, self.shorter.get
        out: list[int] = []
        dead = bytearray(n + 1)
        at, last, t = 0, -1, longest[0]
        while True:
            while t >= 0:
                end = at + lengths[t]
                if not dead[end]:
                    if last < 0 or (good := known((last, t))):
                        break
                    if good is None and self.compatible(last, t):
                        break
                t = p if (p := prefixes(t)) is not None else self._prefix(t)
            if t >= 0:
                out.append(t)
                if end == n:
                    return out
                at, last = end, t
                if (t := longest.get(at)) is None:
                    t = longest[at] = self._longest_at(data, latin, at)
            else:  # nothing fits here: no exact encoding passes through this position
                dead[at] = 1
                t = out.pop()
                at -= lengths[t]
                last = out[-1] if out else -1

    def _longest_at(self, data: bytes, latin: str, at: int) -> int:
        """The longest token that starts at a position that no leftmost match starts at."""
        end = at + self.trie.longest_prefix(latin[at : at + self.widest])
        while (t := self.vocab.get(data[at:end])) is None:
            end -= 1
        return t

    @lru_cache(maxsize=100_000)  # noqa: B019
    def _self_encoded(self, t: int) -> bool:
        """Whether merging by rank turns the bytes of token t into t itself."""
        pair = self.parts.get(t)
        return pair is None or (self._self_encoded(pair[0]) and self._self_encoded(pair[1]) and self._joins(*pair))

    def _joins(self, a: int, b: int) -> bool:
        """a and b stand beside each other until their own merge comes."""
        x, y, bound, whole = a, b, 1 << 62, self.made[a, b]
        while True:
            m = self.made.get((x, y))
            if m is not None and m < bound and m != whole:
                return False
            left, right = self.parts.get(x), self.parts.get(y)
            if left is None and right is None:
                return True
            if right is None or (left is not None and x > y):
                bound, x = x, left[1]
            else:
                bound, y = y + 1, right[0]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The uint32 ids of each text."""
        return encode_texts(texts, self.pieces, self.special)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the decoded text; broken sequences become U+FFFD."""
        out = []
        for at in range(0, len(ids), 1 << 20):
            part = ids[at : at + (1 << 20)].astype(np.int64)
            size = self.size[part]
            ends = np.cumsum(size)
            where = np.repeat(self.offset[part] - (ends - size), size)
            where += np.arange(where.size)
            out.append(self.blob[where].tobytes())
        data = b"".join(out)
        try:
            data.decode("utf-8")
            return data
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode("utf-8")


def codec(path: str) -> Codec:
    return worker_cache("bpe", path, lambda: Codec(path))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids of every whole text."""
    df = id_text(docs, id_col, text_col)

    def run(batch):
        c = codec(vocabulary)
        ids = [i.astype(np.int32) for i in c.encode(batch.column(1).to_pylist())]
        yield {"doc_id": batch.column(0), "ids": ids}

    return map_docs(df, run, f"doc_id {ddl(df, 'doc_id')}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts of arrays of ids (null: empty)."""
    df = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))

    def run(batch):
        c = codec(vocabulary)
        ids = batch.column(1).to_pylist()
        yield {"doc_id": batch.column(0), "text": [c.decode(np.asarray(i or [], np.uint32)).decode() for i in ids]}

    return map_docs(df, run, f"doc_id {ddl(df, 'doc_id')}, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, returning digests of both.

    doc_id, n_tokens long, ids_sha256, decoded_sha256, lossless boolean.  Ids
    are neither shuffled nor kept, so this suits corpora of any size.
    """
    df = id_text(docs, id_col, text_col)

    def run(batch):
        c = codec(vocabulary)
        counts, ids, texts, same = [], [], [], []
        source = batch.column(1).to_pylist()
        for t, one in zip(source, c.encode(source)):
            back = c.decode(one)
            counts.append(len(one))
            ids.append(hashlib.sha256(one.astype("<u4").tobytes()).hexdigest())
            texts.append(hashlib.sha256(back).hexdigest())
            same.append(back == t.encode("utf-8"))
        yield {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": texts, "lossless": same}

    return map_docs(df, run, f"doc_id {ddl(df, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
