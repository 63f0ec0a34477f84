"""Best-fit packing by minimum bin slack.

Every document becomes its token ids plus an end id; only documents longer
than a sequence are cut, from the end, into whole sequences and one first
piece with what remains.  Pieces are packed by length alone:

* the histogram of piece lengths has at most ``capacity`` rows, so it is the
  only thing the driver sees;
* bin by bin, the largest length left is placed, and a bitset subset-sum
  dynamic programme over the available lengths (with their multiplicities)
  finds the fullest feasible combination for the rest of the bin;
* the combination is removed, as often as the counts allow, so that the plan
  has a bounded number of patterns whatever the corpus;
* the pieces of each length are ranked, without sorting a length in one task,
  and the plan turns (length, rank) into (sequence, offset).

Null text counts as empty (one piece of the end id).  Repeated rows are packed
one by one.  Empty input gives no pieces.  Extra columns are ignored.  Pieces
of one length are interchangeable: a hash of the id decides, then id and piece.
A very long text is encoded whole by one task, whose memory follows its length.
"""

from __future__ import annotations

import zlib
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import bpe, ranking
from chronoweave.llm.common import Scratch, ddl, id_text, map_docs, worker_cache
from chronoweave.llm.pretokens import Pieces, encode_texts


def _tokens(vocabulary: str) -> tuple[Pieces, dict[str, int]]:
    """Merging by rank, in tiktoken's library, of the vocabulary's tokens."""

    def make():
        import tiktoken

        ranks, special, _ = bpe.load(vocabulary)
        merge = tiktoken.Encoding("packing", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
        return Pieces(merge._encode_single_piece), special

    return worker_cache("packing", vocabulary, make)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids]: the pieces of every document."""
    df = id_text(docs, id_col, text_col)
    schema = f"doc_id {ddl(df, 'doc_id')}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batch):
        cache, special = _tokens(vocabulary)
        owner, piece, start, length, crc, out = [], [], [], [], [], []
        tail = np.asarray([end_id], np.uint32)
        for row, ids in enumerate(encode_texts(batch.column(1).to_pylist(), cache, special)):
            ids = np.concatenate([ids, tail]).astype("<u4")
            for k, (at, size) in enumerate(cut(len(ids), capacity)):
                part = ids[at : at + size]
                owner.append(row)
                piece.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(part.tobytes()))
                if with_ids:
                    out.append(part.astype(np.int32))
        yield {"doc_id": batch.column(0).take(owner), "piece": piece, "start": start, "length": length, "ids_crc32": crc} | ({"ids": out} if with_ids else {})

    return map_docs(df, run, schema)


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths, with repeats, of the fullest combination of at most ``room``.

    ``counts``: how many there are of each length.  Bit s of a bitset says
    that the sum s can be reached.  Among equally full combinations, larger
    lengths are preferred.
    """
    sets, steps, reach = [], [], 1
    mask = (1 << (room + 1)) - 1
    for size in sorted(k for k, v in counts.items() if v and k <= room):
        left, times = min(counts[size], room // size), 1
        while left:  # multiplicities by binary splitting
            take = min(times, left)
            sets.append(reach)
            steps.append((size, take))
            reach = (reach | reach << size * take) & mask
            left -= take
            times *= 2
    want, out = reach.bit_length() - 1, []
    for before, (size, take) in zip(reversed(sets), reversed(steps)):
        if want >= size * take and before >> (want - size * take) & 1:
            out += [size] * take
            want -= size * take
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(first sequence, sequences, [(length, pieces a sequence)]) for all pieces."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    out, at = [], 0
    while counts:
        top = max(counts)
        counts[top] -= 1
        held: dict[int, int] = {top: 1}
        for size in fullest(capacity - top, counts):
            held[size] = held.get(size, 0) + 1
        counts[top] += 1
        times = min(counts[k] // c for k, c in held.items())
        for k, c in held.items():
            counts[k] -= c * times
            if not counts[k]:
                del counts[k]
        out.append((at, times, sorted(held.items(), reverse=True)))
        at += times
    return out


class Placement:
    """Turns (length, rank) into (sequence, offset)."""

    def __init__(self, patterns: list[tuple[int, int, list[tuple[int, int]]]]) -> None:
        used: dict[int, int] = {}
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        for at, times, held in patterns:
            offset = 0
            for size, c in held:
                first = used.get(size, 0)
                rows.setdefault(size, []).append((first, c, at, offset))
                used[size] = first + c * times
                offset += c * size
        self.rows = {k: np.asarray(v, np.int64).T for k, v in rows.items()}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for size in np.unique(length).tolist():
            here = np.flatnonzero(length == size)
            first, c, at, base = self.rows[size]
            k = np.searchsorted(first, rank[here], "right") - 1
            past = rank[here] - first[k]
            sequence[here] = at[k] + past // c[k]
            offset[here] = base[k] + past % c[k] * size
        return sequence, offset


def place(parts: DataFrame, capacity: int = 1024, seed: int = 42) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with a column ``length``.

    ``parts`` is read twice, so it should be a written table.  Further columns
    are kept; doc_id and piece order the pieces of a length.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    where = Placement(plan(histogram, capacity))
    d = parts.withColumn("__cw_at", ranking.spread(F.col("doc_id"), F.col("piece"), seed=seed))
    buckets = ranking.bucket_count(sum(histogram.values()))
    d = ranking.ranked(d, "length", "__cw_at", ["doc_id", "piece"], buckets, rank="__cw_rank").drop("__cw_at")
    keep = [c for c in parts.columns]
    schema = ", ".join(f"`{c}` {ddl(parts, c)}" for c in keep) + ", sequence_id long, offset long"

    def run(batch):
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__cw_rank"))
        sequence, offset = where(length, rank)
        yield {c: batch.column(c) for c in keep} | {"sequence_id": sequence, "offset": offset}

    return map_docs(d, run, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    ``with_ids`` adds the ids of each piece: grouped by sequence_id and ordered
    by offset they are the packed sequences.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    parts = scratch.table(pieces(docs, vocabulary, capacity, end_id, with_ids, id_col, text_col))
    return place(parts, capacity, seed)
