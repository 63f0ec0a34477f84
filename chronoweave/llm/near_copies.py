"""Near copies by Jaccard similarity of word shingles, found whole.

Two texts link if the sets of their ``shingle``-word shingles have a Jaccard
similarity of ``similarity`` or more.  At 0.8 some ten of 64 SimHash bits are
expected to differ, where multi-index hashing has no segment long enough to
look up, so SimHash alone finds but the nearest copies.

*First links.*  Texts with equal sets are one class.  Classes within 3 SimHash
bits, and each class with the pivot of a shingle in its prefix, are candidates;
verified ones join classes, so a large group of near copies needs no pairs of
its own.  The pivot of a shingle is a set with the fewest others ahead of it: of
copies that were edited each in its own way, the one that was edited least, and
so the one that most of them reach.

*The rest.*  Sets are ordered by one order of all shingles, the more frequent
the later.  Of two sets that reach the similarity, the first
``n - ceil(similarity * n) + 1`` shingles of each (its prefix) have one in common,
so every link is met in some shingle.  Only classes that first links have not
joined are compared, and only at shingles that can be the first they share: what
they have in common then stands from there on in both, so a pair with too little
left in either set is no pair of this shingle.  At a shingle the sets of its main
component are met by those of the others alone.  How frequent shingles are is
estimated on a sample of texts: any order gives the same links.

*Verification.*  Every set has a sketch: a row of about two to four bits an
element in which each element flips one.  The bits in which two sketches differ
never outnumber the elements in which the sets do, so a pair whose sketches are
too far apart cannot reach the similarity.  Most candidates fall there; only
what is left has its whole sets fetched and compared.  The join of the rest
tests a sketch of ``64 * PARTS`` bits on the way, which rules out most pairs of
sets of a few hundred shingles before they become rows; larger sets are left to
the sketches that grow with them.

Words are lower-cased in A-Z.  Texts of fewer words are one shingle; texts
without a word are equal to one another.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import simhash
from chronoweave.llm import vector_text as vt
from chronoweave.llm.common import Scratch, ddl, id_text, map_docs, rows_in
from chronoweave.llm.components import connected_components


PARTS = 8
SHORT = [f"s{i}" for i in range(PARTS)]


def sets(w: vt.Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their bounds."""
    n = len(w.counts)
    count = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(n), count)
    k = np.arange(len(owner)) + (w.first[:-1] - np.cumsum(count) + count)[owner]
    values = vt.Ranges(w.hashes()).hash(k, np.minimum(k + shingle, w.first[1:][owner])) if len(k) else np.empty(0, np.uint64)
    bare = np.flatnonzero(count == 0)
    owner, values = np.concatenate([owner, bare]), np.concatenate([values, np.zeros(len(bare), np.uint64)])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(n + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of each set."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(vt.mix(values + np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
    return vt.mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def sketches(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the sketches of all sets, one behind another, and their bounds.

    A set of n elements has the least power of two from 2 n (and 64) as its number of bits.
    """
    n = np.diff(bounds)
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(n)), n)
    place = base[:-1][owner] + (values & (bits - 1).astype(np.uint64)[owner]).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=base[-1]).astype(np.uint8) & 1, bitorder="little"), base // 8


def short_sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A sketch of ``64 * PARTS`` bits of each set, a column for each 64 bits."""
    n, bits = len(bounds) - 1, np.uint64(64 * PARTS - 1)
    place = np.repeat(np.arange(n), np.diff(bounds)) * 64 * PARTS + ((values >> np.uint64(20)) & bits).astype(np.int64)
    odd = np.bincount(place, minlength=n * 64 * PARTS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, PARTS)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the other."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(s.reshape(-1, size), axis=0) for s in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _signed(df: DataFrame, shingle: int, seed: int) -> DataFrame:
    """doc_id, fp, sig, n, sketch and the columns SHORT of every text."""

    def run(batch):
        for part in rows_in([batch], 400_000):
            w = vt.Words(part.column(1))
            values, bounds = sets(w, shingle)
            short = short_sketches(values, bounds)
            yield {
                "doc_id": part.column(0), "fp": simhash.of_words(w, shingle, seed).view(np.int64), "sig": signatures(values, bounds),
                "n": np.diff(bounds).astype(np.int32), "sketch": _binary(*sketches(values, bounds)), **{c: short[:, i] for i, c in enumerate(SHORT)},
            }

    return map_docs(df, run, f"doc_id {ddl(df, 'doc_id')}, fp long, sig long, n int, sketch binary, " + ", ".join(f"{c} long" for c in SHORT))


def _frequent(df: DataFrame, shingle: int, every: int = 8, least: int = 2, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that stand in several texts of each ``every``-th, and their grades; it only orders.

    At most ``most`` shingles, nine bytes each, reach the driver and the tasks.
    """

    def run(batch):
        for part in rows_in([batch], 1_000_000):
            key, c = np.unique(sets(vt.Words(part.column(1)), shingle)[0], return_counts=True)
            yield {"key": key.view(np.int64), "c": c}

    some = df.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    often = map_docs(some, run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    found = often.orderBy(F.desc("c"), "key").limit(most).toArrow()
    key, c = found["key"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.argsort(key)
    return key[order], np.log2(np.maximum(c, 1)).astype(np.int8)[order] + np.int8(1)


def _prefixes(df: DataFrame, shingle: int, similarity: float, frequent: np.ndarray, grades: np.ndarray) -> DataFrame:
    """key, sig, n, pos: the prefix of every set."""

    def run(batch):
        for part in rows_in([batch], 400_000):
            values, bounds = sets(vt.Words(part.column(1)), shingle)
            sig, n = signatures(values, bounds), np.diff(bounds)
            owner = np.repeat(np.arange(len(n)), n)
            late = np.zeros(len(values), np.int8)
            if len(frequent):
                at = np.searchsorted(frequent, values)
                at[at == len(frequent)] = 0
                late = np.where(frequent[at] == values, grades[at], np.int8(0))
            order = np.lexsort((late, owner))  # stable: sorted by value within
            pos = np.arange(len(values)) - bounds[:-1][owner]
            short = pos < (n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1)[owner]
            o = owner[short]
            yield {"key": values[order][short].view(np.int64), "sig": sig[o], "n": n[o].astype(np.int32), "pos": pos[short].astype(np.int32)}

    return map_docs(df, run, "key long, sig long, n int, pos int")


def _ends(pairs: DataFrame, of: DataFrame, *cols: str) -> DataFrame:
    """pairs (a, b) with the columns of both signatures, those of b with 2 at the end."""
    a = of.select(F.col("sig").alias("a"), *cols)
    b = of.select(F.col("sig").alias("b"), *[F.col(c).alias(c + "2") for c in cols])
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", *[c + e for c in cols for e in ("", "2")])


def _close(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The rows (a, b) of pairs whose sketches allow the similarity."""
    part = (1 - similarity) / (1 + similarity)

    def run(batch):
        both = np.asarray(batch.column(2)).astype(np.int64) + np.asarray(batch.column(3))
        ok = []
        for most, x, y in zip((part * both + 1e-6).tolist(), batch.column(4), batch.column(5)):
            ok.append(apart(*(np.frombuffer(s.as_buffer(), np.uint8) for s in (x, y))) <= most)
        kept = batch.filter(pa.array(ok, pa.bool_()))
        yield {"a": kept.column(0), "b": kept.column(1)}

    return map_docs(_ends(pairs, reps, "n", "sketch"), run, "a long, b long")


def _verified(candidates: DataFrame, reps: DataFrame, df: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """The rows (a, b) of candidates whose sets reach the similarity."""
    pairs = scratch.table(_close(candidates, reps, similarity))
    need = scratch.table(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct())
    scratch.sweep()
    ids = reps.join(need.hint("merge"), "sig", "left_semi").select("id").distinct()
    texts = df.join(ids.hint("merge"), df["doc_id"].eqNullSafe(ids["id"]), "left_semi")

    def run(batch):
        for part in rows_in([batch], 400_000):
            values, bounds = sets(vt.Words(part.column(1)), shingle)
            yield {"sig": signatures(values, bounds), "held": _binary(values, bounds * 8)}

    held = map_docs(texts, run, "sig long, held binary").dropDuplicates(["sig"])
    held = scratch.table(held.join(need.hint("merge"), "sig", "left_semi"))
    scratch.sweep()

    def compare(batch):
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            common = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(common >= similarity * (len(p) + len(q) - common) - 1e-9)
        kept = batch.filter(pa.array(ok, pa.bool_()))
        yield {"a": kept.column(0), "b": kept.column(1)}

    out = scratch.table(map_docs(_ends(pairs, held, "held"), compare, "a long, b long"))
    scratch.drop(pairs, held, need)
    return out


def components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest doc_id that links reach) for every row."""
    scratch = Scratch(docs.sparkSession, "near")
    df = id_text(docs, id_col, text_col)
    signed = scratch.table(_signed(df, shingle, seed))
    reps = scratch.table(signed.groupBy("sig").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), *[F.first(c).alias(c) for c in SHORT]))
    prefixes = scratch.table(_prefixes(df, shingle, similarity, *_frequent(df, shingle)))
    scratch.sweep()
    # Keys alone are shuffled here; keys that only equal sets share are dropped by later steps.
    shared = scratch.table(prefixes.groupBy("key").count().where("count > 1").select("key"))
    scratch.sweep()
    near = scratch.table(prefixes.join(shared.hint("merge"), "key").dropDuplicates(["key", "sig"]))
    scratch.drop(prefixes, shared)

    fps = scratch.table(signed.groupBy("fp").agg(F.min("sig").alias("rep")))
    bits = simhash.class_links(fps, scratch).select("a", "b")
    same = signed.select("fp", "sig").distinct().join(fps.hint("merge"), "fp").select(F.greatest("sig", "rep").alias("a"), F.least("sig", "rep").alias("b"))
    by = near.select("key", "sig", "n", "pos", F.xxhash64("sig", F.pmod("key", F.lit(2))).alias("h"))
    pivot = by.groupBy("key").agg(F.min(F.struct("pos", "h", "sig", "n")).alias("p"))
    pivot = scratch.table(pivot)
    star = by.join(pivot.hint("merge"), "key").where(F.least("n", "p.n") >= similarity * F.greatest("n", "p.n") - 1e-9)
    star = star.select(F.greatest("sig", "p.sig").alias("a"), F.least("sig", "p.sig").alias("b"))
    first = scratch.table(bits.union(same).union(star).where("a <> b").distinct())
    scratch.drop(fps, pivot)
    links = _verified(first, reps, df, shingle, similarity, scratch)

    group = connected_components(links, scratch).select(F.col("node").alias("sig"), "component")
    group = scratch.table(group)
    split = near.join(group.hint("merge"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    split = scratch.table(split)
    scratch.drop(near, group)
    held = split.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    held = held.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least"))
    apart = scratch.table(held.where("x <> y").select("key", F.col("m.component").alias("main"), "least"))
    # At the first key of a pair nothing before it is common, so what is common stands from there on in both.
    part = similarity / (1 + similarity)
    enough = F.col("n") - F.col("pos") >= part * (F.col("n") + F.greatest(F.col("least"), similarity * F.col("n"))) - 1e-9
    left = split.join(apart.hint("merge"), "key").where(enough).withColumn("main", F.col("component") == F.col("main"))
    left = scratch.table(left.drop("least").join(reps.select("sig", *SHORT).hint("merge"), "sig"))
    scratch.drop(split, apart)
    right = left.select("key", F.col("main").alias("side"), F.col("sig").alias("sig2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("component").alias("component2"), *[F.col(c).alias(c + "2") for c in SHORT])
    # The smaller set (then the lesser signature) is on the left, so each pair is met once a key.
    fits = (F.col("component") != F.col("component2")) & (F.struct("n", "sig") < F.struct(F.col("n2").alias("n"), F.col("sig2").alias("sig"))) & (F.col("n") >= similarity * F.col("n2") - 1e-9)
    ahead = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    differ = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(c + "2"))) for c in SHORT])
    fits = fits & (differ <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("n2")) + 1e-6)
    smaller = left.where(F.col("n") - F.col("pos") >= 2 * part * F.col("n") - 1e-9)
    # The main component of a key (that of most of its sets) is met by the others alone.
    smaller = smaller.withColumn("side", F.explode(F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    rest = smaller.join(right.hint("merge"), ["key", "side"]).where(fits & (ahead >= part * (F.col("n") + F.col("n2")) - 1e-9))
    rest = scratch.table(rest.select(F.greatest("sig", "sig2").alias("a"), F.least("sig", "sig2").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    scratch.drop(left, first)
    links = links.union(_verified(rest, reps, df, shingle, similarity, scratch))

    whole = connected_components(links, scratch).select(F.col("node").alias("sig"), "component")
    of = scratch.table(signed.select("doc_id", "sig").join(whole.hint("merge"), "sig", "left").select("doc_id", F.coalesce("component", "sig").alias("component")))
    least = scratch.table(of.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return of.join(least.hint("merge"), "component").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of each component, all columns kept.

    Rows that repeat an id and rows without one: see :func:`simhash.keep_one`.
    """
    return simhash.keep_found(docs, components(docs, similarity, shingle, seed, id_col, text_col), id_col, text_col)
