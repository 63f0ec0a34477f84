"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

A section ends with a blank line, a paragraph is a line with its line end, and
a leaf is up to four words of one sentence with the white space after them
(a paragraph's first leaf takes what stands before its first word, too).  So
leaves cover every byte of a text.  A leaf's hash is the SHA-256 of its bytes,
that of every node above the SHA-256 of its children's hashes, each level with
a tag of its own.  Equal roots therefore mean equal texts, and walking down
from two roots along differing branches locates an edit.

The likeness of two trees is the share of leaves they have in common, as a
multiset (Dice), found by the same walk: equal sections count whole, of the
others equal paragraphs do, and only below differing paragraphs are leaves
compared (by the first 8 bytes of their hashes).

Null text counts as empty; the empty tree has a root of its own, and two empty
texts are alike (1.0), an empty and another one are not (0.0).  Rows without an
id come after all others; rows that repeat an id follow in the order of their
texts, and equal rows in any order.  Ids are of any type that has an order.
An empty table gives no rows.  A very long text is one row of one task, whose
memory follows its length.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import vector_text as vt
from chronoweave.llm.common import ddl, id_text, map_docs, rows_in

LEAF_WORDS = 4


def _node(tag: bytes, children: list[bytes]) -> bytes:
    return hashlib.sha256(tag + b"".join(children)).digest()


class Tree(NamedTuple):
    root: str
    sections: list[bytes]
    paragraphs: list[bytes]
    first_paragraph: list[int]  # of each section, and the end
    first_leaf: np.ndarray  # of each paragraph, and the end
    leaves: np.ndarray  # first 8 bytes of each leaf's hash


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where leaves and paragraphs of a text (UTF-8 bytes) begin."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.flatnonzero(data == 10) + 1
    paragraphs = np.concatenate([[0], ends[ends < n]])
    white = ~vt.byte_table(vt.WHITE, False)[0][data]
    starts = ~white
    starts[1:] &= white[:-1]
    start = np.flatnonzero(starts)
    if not len(start):
        return paragraphs, paragraphs
    last = ~white
    last[:-1] &= white[1:]
    stop = np.isin(data[np.flatnonzero(last)], (33, 46, 63))
    line = np.searchsorted(paragraphs, start, "right")
    fresh = np.ones(len(start), bool)  # words that begin a sentence
    fresh[1:] = stop[:-1] | (line[1:] > line[:-1])
    k = np.arange(len(start))
    since = k - np.maximum.accumulate(np.where(fresh, k, 0))
    opens = np.ones(len(start), bool)  # first words of paragraphs, whose leaves begin with the paragraph
    opens[1:] = line[1:] > line[:-1]
    inner = start[(since % LEAF_WORDS == 0) & ~opens]
    return np.sort(np.concatenate([paragraphs, inner])), paragraphs


def tree(text: str) -> Tree:
    raw = text.encode("utf-8")
    begin, paragraph = cuts(np.frombuffer(raw, np.uint8))
    at = [*begin.tolist(), len(raw)]
    sha = hashlib.sha256
    leaves = [sha(b"L" + raw[a:b]).digest() for a, b in zip(at, at[1:])]
    first = np.searchsorted(begin, np.append(paragraph, len(raw)))
    of = first.tolist()
    paragraphs = [_node(b"P", leaves[a:b]) for a, b in zip(of, of[1:])]
    ends = [*paragraph.tolist()[1:], len(raw)]
    bounds = [0, *[k + 1 for k, (a, b) in enumerate(zip(paragraph.tolist(), ends)) if raw[a:b].isspace() and k + 1 < len(paragraphs)]]
    if paragraphs:
        bounds.append(len(paragraphs))
    sections = [_node(b"S", paragraphs[a:b]) for a, b in zip(bounds, bounds[1:])]
    short = np.frombuffer(b"".join(leaves), np.uint64).reshape(-1, 4)[:, 0] if leaves else np.empty(0, np.uint64)
    return Tree(_node(b"R", sections).hex(), sections, paragraphs, bounds, first, short)


def _unmatched(x: list[bytes], y: list[bytes]) -> tuple[list[int], list[int]]:
    """Places of x and y that are left when equal hashes are paired off."""
    spare = Counter(x) & Counter(y)
    out = []
    for side in (x, y):
        held, left = dict(spare), []
        for k, h in enumerate(side):
            if held.get(h, 0):
                held[h] -= 1
            else:
                left.append(k)
        out.append(left)
    return out[0], out[1]


def likeness(a: Tree, b: Tree) -> float:
    """Twice the common leaves over all leaves, by a walk along differing branches; 1 for equal roots."""
    if a.root == b.root:
        return 1.0
    total = len(a.leaves) + len(b.leaves)
    if not len(a.leaves) or not len(b.leaves):
        return 0.0
    below = []
    for t, sections in zip((a, b), _unmatched(a.sections, b.sections)):
        below.append([p for s in sections for p in range(t.first_paragraph[s], t.first_paragraph[s + 1])])
    left = _unmatched([a.paragraphs[p] for p in below[0]], [b.paragraphs[p] for p in below[1]])
    apart = []
    for t, mine, places in zip((a, b), below, left):
        p = np.asarray([mine[k] for k in places], np.int64)
        size = t.first_leaf[p + 1] - t.first_leaf[p]
        apart.append(t.leaves[np.repeat(t.first_leaf[p] - np.cumsum(size) + size, size) + np.arange(size.sum())])
    x, nx = np.unique(apart[0], return_counts=True)
    y, ny = np.unique(apart[1], return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = len(a.leaves) - len(apart[0]) + np.minimum(nx[i], ny[j]).sum()
    return float(2 * common / total)


def first_difference(a: Tree, b: Tree) -> tuple[int | None, int | None]:
    """Indices of the first differing section and of the paragraph in it; None: no difference."""
    if a.root == b.root:
        return None, None
    k = next((k for k, (x, y) in enumerate(zip(a.sections, b.sections)) if x != y), min(len(a.sections), len(b.sections)))
    if k >= len(a.sections) or k >= len(b.sections):
        return k, 0
    x, y = (t.paragraphs[t.first_paragraph[k] : t.first_paragraph[k + 1]] for t in (a, b))
    return k, next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, n_sections, n_paragraphs, n_leaves of every whole text."""
    df = id_text(docs, id_col, text_col)

    def run(batch):
        t = [tree(x) for x in batch.column(1).to_pylist()]
        yield {"doc_id": batch.column(0), "fingerprint": [x.root for x in t], "n_sections": [len(x.sections) for x in t], "n_paragraphs": [len(x.paragraphs) for x in t], "n_leaves": [len(x.leaves) for x in t]}

    return map_docs(df, run, f"doc_id {ddl(df, 'doc_id')}, fingerprint string, n_sections int, n_paragraphs int, n_leaves int")


def edited(text: str, after: str) -> str:
    """The last quarter of ``text`` replaced by as many leading code points of ``after``."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def range_bounds(df: DataFrame, rows: int, parts: int, each: int = 50) -> list:
    """At most ``parts - 1`` ascending ids that cut the rows into even ranges.

    Every ``each``-th of some ``each * parts`` ids, taken by their hash and
    sorted by Spark: so only the bounds come to the driver, and they only
    decide how evenly the ranges are dealt.
    """
    span = 1 << 30
    take = min(span, -(-span * each * parts // max(1, rows)))
    some = df.select("doc_id").where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(span)) < take)).orderBy("doc_id")

    def every(batches):
        k = 0
        for batch in batches:
            at = np.flatnonzero((k + np.arange(batch.num_rows)) % each == each - 1)
            k += batch.num_rows
            if len(at):
                yield batch.take(pa.array(at))

    return sorted({r[0] for r in some.mapInArrow(every, some.schema).collect()})


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_mb: float = 8.0, most_mb: float = 256.0) -> DataFrame:
    """bucket, late, doc_id, text: every row, dealt by id ranges, and after each range the row that follows it.

    Rows with ``late`` follow a range only to be looked at.  Ranges hold some
    ``range_mb`` of text, more where there are very many (with the root of the
    input, up to ``most_mb``).  Each range is a partition sorted by Spark, so
    texts are shuffled once and no range need fit in memory.
    """
    df = id_text(docs, id_col, text_col)
    n, size, low = df.agg(F.count("doc_id"), F.sum(F.octet_length("text")), F.min("doc_id")).first()
    size = size or 0
    each = max(range_mb * 1e6, min(most_mb * 1e6, (size * 65536) ** 0.5))
    bounds = [b for b in range_bounds(df, n, max(8, int(-(-size // each)))) if b > low] if n else []
    last, kind = len(bounds), df_type(df)
    cut = np.asarray(bounds, np.int64 if pa.types.is_integer(kind) else object)
    schema = pa.schema([("bucket", pa.int32()), ("late", pa.bool_()), ("doc_id", kind), ("text", pa.string())])

    def deal(batches):
        for batch in rows_in(batches):
            ids, texts = batch.column(0), batch.column(1).cast(pa.string())
            rows = len(ids)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            value = np.asarray([low if v is None else v for v in ids.to_pylist()], cut.dtype)
            bucket = np.where(known, np.searchsorted(cut, value, "right"), last).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(rows, bool)), ids, texts], schema=schema)
            first = np.zeros(rows, bool)
            if last:
                first = known & (bucket > 0)
                first &= np.asarray(cut[np.maximum(bucket, 1) - 1] == value, bool)
            around = (known & np.asarray(value == low, bool)) if n else ~known  # after the last row comes the first
            for mask, where in ((first, bucket - 1), (around, np.full(rows, last))):
                if mask.any():
                    at = np.flatnonzero(mask)
                    yield pa.RecordBatch.from_arrays([pa.array(where[at].astype(np.int32)), pa.array(np.ones(len(at), bool)), ids.take(pa.array(at)), texts.take(pa.array(at))], schema=schema)

    dealt = df.mapInArrow(deal, f"bucket int, late boolean, doc_id {ddl(df, 'doc_id')}, text string")
    # A range is a partition: how finely texts are dealt does not hang on the session's default.
    return dealt.repartitionById(last + 1, "bucket").sortWithinPartitions("bucket", "late", F.col("doc_id").asc_nulls_last(), "text")


def df_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["doc_id"].dataType)


def against_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next one's beginning.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edit_section, edit_paragraph (where the two trees
    first differ; null if they do not).  Next: ascending doc_id, and the first
    after the last.
    """
    d = beside_next(docs, id_col, text_col)
    out = pa.schema([("doc_id", df_type(d)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edit_section", pa.int32()), ("edit_paragraph", pa.int32())])

    def row(own, text, own_tree, after, after_tree):
        new = edited(text, after)
        new_tree = own_tree if new == text else tree(new)
        return (own, len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), own_tree.root, new_tree.root, likeness(own_tree, new_tree), likeness(own_tree, after_tree), *first_difference(own_tree, new_tree))

    def walk(batches):
        held = None  # the row that waits for the next one of its range
        for batch in rows_in(batches, 4_000_000):
            rows = []
            for bucket, late, own, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                t = tree(text) if not late or (held and held[0] == bucket) else None
                if held and held[0] == bucket:
                    rows.append(row(*held[1:], text, t))
                held = None if late else (bucket, own, text, t)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return d.mapInArrow(walk, f"doc_id {ddl(d, 'doc_id')}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_section int, edit_paragraph int")
