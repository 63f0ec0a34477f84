"""Suffix-array dedup: passages of ``min_words`` words or more that repeat across documents.

*Sparse suffixes.*  Of all word suffixes only those at minimisers are kept: a
window of ``min_words`` words is held by the position in it whose first ``k``
words have the least hash, of equals by the first.  This position depends on
the window's words alone, so a repeated window is held by the same suffix
wherever it stands, and every window by one suffix only.

*Neighbours.*  Suffixes with the same first k words are neighbours in suffix
order; they are brought together by the hash of those words (not by one total
sort, so a passage that very many documents share is counted before it is
shuffled).  Neighbours from at least two documents are compared by what stands
around them.

*Extension.*  The context of a suffix reaches as far left and right as the
windows it holds.  Where all neighbours agree on it, the match extends over all
of it.  Where they differ, the match is extended word by word: every window
that the suffix holds is hashed and found again in other documents.  The union
is exact: the words covered by a window of ``min_words`` words that stands in
two documents.

Why no comparison of neighbours in one suffix order: a suffix's neighbour
shares most words to its right, but a third suffix that shares fewer to the
right and more to the left can be the only one with which it shares a whole
window; such links would be lost.

The first place (smallest doc_id, then position) of a window keeps it; later
places are removed.  Words are white-space delimited and compared exactly.
Null or short texts have no passages; rows without an id are left alone; equal
rows count as one document, and rows that repeat an id with other texts are
documents of their own, in the order of a hash of their texts.  An empty table
gives no rows.  A very long text is read whole by one task, whose memory
follows its length.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import vector_text as vt
from chronoweave.llm.common import Scratch, ddl, id_text, map_docs, rows_in


def anchors(grams: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``width`` values that are valid, and the index of the least value of each (of equals the first)."""
    n = len(grams) - width + 1
    if n <= 0 or not valid[:n].any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, size = np.arange(len(grams)), 1

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[a] <= grams[b], a, b)

    while size * 2 <= width:
        at = less(at[:-size], at[size:])
        size *= 2
    at = less(at[:n], at[width - size : width - size + n]) if size < width else at[:n]
    s = np.flatnonzero(valid[:n])
    return s, at[s]


def _bounds(w: vt.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the text of each word."""
    return np.repeat(w.first[:-1], w.counts), np.repeat(w.first[1:], w.counts)


def suffixes(df: DataFrame, min_words: int, k: int) -> DataFrame:
    """gram, context, doc_id, since, until: the kept suffixes of every text and the windows that each stands for."""
    width = min_words - k + 1

    def run(batch):
        for part in rows_in([batch], 1_000_000):
            w = vt.Words(part.column(1), lower=False)
            n = len(w.start)
            if n < min_words:
                continue
            lo, hi = _bounds(w)
            r = vt.Ranges(w.hashes())
            i = np.arange(n)
            grams = r.hash(i, np.minimum(i + k, n))
            s, at = anchors(grams, i + min_words <= hi, width)
            if not len(s):
                continue
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # the windows of one anchor are neighbours
            since, until = s[new], s[np.append(new[1:], len(s)) - 1] + min_words
            base = lo[since]
            yield {
                "gram": grams[at[new]].view(np.int64), "context": r.hash(since, until).view(np.int64), "doc_id": part.column(0).take(w.text_of()[since]),
                "since": (since - base).astype(np.int32), "until": (until - base).astype(np.int32),
            }

    return map_docs(df, run, f"gram long, context long, doc_id {ddl(df, 'doc_id')}, since int, until int")


def windows(df: DataFrame, min_words: int) -> DataFrame:
    """window, doc_id, since: hashes of all windows in the stretches ``at`` of each text."""

    def run(batch):
        for part in rows_in([batch], 1_000_000):
            w = vt.Words(part.column(1), lower=False)
            r = vt.Ranges(w.hashes())
            starts, owner = [], []
            for row, places in enumerate(part.column(2).to_pylist()):
                for p in places:
                    first = int(w.first[row]) + p["since"]
                    starts.append(np.arange(first, first + p["until"] - p["since"] - min_words + 1))
                    owner.append(np.full(len(starts[-1]), row))
            if starts:
                s, o = np.concatenate(starts), np.concatenate(owner)
                yield {"window": r.hash(s, s + min_words).view(np.int64), "doc_id": part.column(0).take(o), "since": (s - w.first[o]).astype(np.int32)}

    return map_docs(df, run, f"window long, doc_id {ddl(df, 'doc_id')}, since int")


def _places(found: DataFrame, key: str, until, scratch: Scratch) -> DataFrame:
    """doc_id, since, until, first_doc_id, removed for keys that stand in two documents.

    What a key needs is aggregated and written first, so that the join has a
    shuffle of its own and a frequent key's rows can be split over tasks.
    """
    first = found.groupBy(key).agg(F.min(F.struct("doc_id", "since")).alias("f"), F.max("doc_id").alias("most")).where("f.doc_id <> most")
    return found.join(scratch.table(first).hint("merge"), key).select("doc_id", "since", until.alias("until"), F.col("f.doc_id").alias("first_doc_id"), ((F.col("doc_id") != F.col("f.doc_id")) | (F.col("since") != F.col("f.since"))).alias("removed"))


def passages(docs: DataFrame, min_words: int = 50, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, n_words, first_doc_id, removed: maximal repeated stretches.

    Stretches of kept and of removed words are joined separately; first_doc_id
    is the smallest id among the first places of their windows.
    """
    out = _passages(id_text(docs, id_col, text_col).where("doc_id is not null"), min_words, k)
    return out.select(*[F.col(f"{c}.doc_id").alias(c) if ddl(out, c).startswith("struct") else c for c in out.columns])


def _repeats(df: DataFrame) -> bool:
    """Whether rows repeat an id."""
    return not df.groupBy("doc_id").count().where("count > 1").isEmpty()


def _key(text: str = "text"):
    """Names a document where ids repeat."""
    return F.struct("doc_id", F.xxhash64(text).alias("of"))


def _passages(df: DataFrame, min_words: int, k: int) -> DataFrame:
    """What :func:`passages` gives; where ids repeat, doc_id and first_doc_id are structs with a hash of the text."""
    scratch = Scratch(df.sparkSession, "suffixes")
    if _repeats(df):
        df = df.select(_key().alias("doc_id"), "text")
    kept = scratch.table(suffixes(df, min_words, k))
    groups = kept.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.min("context") != F.max("context")).alias("mixed")).where("a <> b")
    repeated = scratch.table(groups.select("gram", "mixed"))  # written first, so that a frequent gram's rows can be split over tasks
    near = scratch.table(kept.join(repeated.hint("merge"), "gram"))
    scratch.drop(kept)
    whole = _places(near.where("not mixed"), "gram", F.col("until"), scratch)
    at = near.where("mixed").groupBy("doc_id").agg(F.collect_list(F.struct("since", "until")).alias("at"))
    met = scratch.table(windows(df.join(at.hint("merge"), "doc_id").select("doc_id", "text", "at"), min_words))
    parts = _places(met, "window", F.col("since") + min_words, scratch)
    both = whole.unionByName(parts)
    order = Window.partitionBy("doc_id", "removed").orderBy("since", "until")
    seen = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = both.select("*", seen.alias("__cw_seen")).withColumn("island", F.sum((F.coalesce("__cw_seen", F.lit(-1)) < F.col("since")).cast("int")).over(order))
    spans = out.groupBy("doc_id", "removed", "island").agg(F.min("since").alias("start_word"), F.max("until").alias("end"), F.min("first_doc_id").alias("first_doc_id"))
    result = scratch.table(spans.select("doc_id", "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "first_doc_id", "removed"))
    scratch.drop(near, met)
    return result


def strip(docs: DataFrame, min_words: int = 50, k: int = 20, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs without the later places of repeated passages, all columns kept.

    Words of a window that its document keeps stay, also where a later place
    overlaps them.  A removed stretch goes with the white space after it.  Documents of which
    no word is left go; a column of character counts follows the text.
    """
    known = id_text(docs, id_col, text_col).where("doc_id is not null")
    found = _passages(known, min_words, k)
    apart = ddl(found, "doc_id").startswith("struct")
    cuts = found.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words", "removed")).alias("__cw_cuts")).where("exists(__cw_cuts, c -> c.removed)").withColumnRenamed("doc_id", "__cw_id")
    # Cuts grow with the input: never broadcast, so every size has this plan.
    own = F.struct(docs[id_col].alias("doc_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("of")) if apart else docs[id_col]
    joined = docs.withColumn("__cw_own", own).join(cuts.hint("merge"), F.col("__cw_own") == cuts["__cw_id"], "left").drop("__cw_id", "__cw_own")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batch):
        import pyarrow as pa

        for part in rows_in([batch], 1_000_000):
            lists = part.column(len(names)).to_pylist()
            w = vt.Words(part.column(at), lower=False)
            texts, keep = part.column(at).to_pylist(), np.ones(part.num_rows, bool)
            for row, cut in enumerate(lists):
                if not cut:
                    continue
                lo, n = int(w.first[row]), int(w.counts[row])
                base = int(w.offsets[row])
                raw = w.raw[base : int(w.offsets[row + 1])].tobytes()
                go = np.zeros(n + 2, bool)
                for c in sorted(cut, key=lambda c: not c["removed"]):  # what is kept comes last
                    go[c["start_word"] + 1 : c["start_word"] + c["n_words"] + 1] = c["removed"]
                gone, here, out = np.flatnonzero(go[1:] != go[:-1]).reshape(-1, 2).tolist(), 0, []
                left = n
                for a, b in gone:
                    out.append(raw[here : int(w.start[lo + a]) - base])
                    here = int(w.start[lo + b]) - base if b < n else len(raw)
                    left -= b - a
                out.append(raw[here:])
                texts[row] = b"".join(out).decode("utf-8")
                keep[row] = left > 0
            where = np.flatnonzero(keep)
            cols = {c: part.column(i).take(pa.array(where)) for i, c in enumerate(names)}
            cols[text_col] = [texts[i] for i in where.tolist()]
            if count_col in names:
                counts = part.column(names.index(count_col)).to_pylist()
                cols[count_col] = [len(texts[i]) if lists[i] else counts[i] for i in where.tolist()]
            yield cols

    return map_docs(joined, run, ", ".join(f"`{c}` {ddl(docs, c)}" for c in names))
