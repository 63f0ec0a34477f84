"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised.  Table t files a vector under its label and ``width``-
quantised projections floor((a.v + b) / w) on ``depth`` Gaussian directions;
vectors at a cosine of 0.98 (distance 0.2) or more share one projection with
probability 0.84, so with 8 projections and 24 tables a link at the threshold
is missed with probability 0.001, closer ones less.  Vectors that share a
bucket are compared by exact cosine in double precision.

Equal vectors of a label are one class; a class is filed once however many
vectors it has.  Buckets with one class, and buckets with the same classes as
one of an earlier table, go before any vector is shuffled.  A bucket of any
size is treated alike: it is cut into blocks, and pairs of blocks are compared
by matrix products, so a bucket never has to fit in one task, and whether a
pair is found depends on its two vectors alone.  Work grows with the square of
a bucket's classes, memory does not.  A pair that meets in several buckets is
counted in the first.
Each block pair returns a count a class and a spanning set of links, never all
pairs.

Vectors that are null, zero, or hold null or non-finite components, and
vectors with a null label, link with nothing and stay.  Every row is a vector,
also one without an id and ones that repeat an id, in one label or several:
n_links counts rows.  component_id is the smallest non-null id; a row without
an id is kept only if no row with one is reached.  Vectors of different
lengths do not link.  Ids are of any type that has an order.  Empty input
gives no rows.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import vector_text as vt
from chronoweave.llm.common import Scratch, ddl, map_docs
from chronoweave.llm.components import connected_components


def keys_of(unit: np.ndarray, tables: int, depth: int, width: float, seed: int) -> np.ndarray:
    """Bucket keys (n, tables) as int64 of unit vectors (n, dim)."""
    rng = np.random.default_rng([seed, unit.shape[1], depth])
    a = rng.normal(size=(unit.shape[1], tables * depth))
    b = rng.uniform(0, width, tables * depth)
    q = np.floor((unit @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, depth)
    out = np.zeros((len(unit), tables), np.uint64)
    for k in range(depth):
        out = vt.mix(out * np.uint64(0x9E3779B97F4A7C15) + q[:, :, k] + np.uint64(k + 1))
    return out.view(np.int64)


def _usable(v) -> bool:
    return v is not None and len(v) > 0 and all(x is not None for x in v) and bool(np.isfinite(v).all()) and any(v)


def _matrix(rows: list, dim: int) -> np.ndarray:
    m = np.asarray(rows, np.float64).reshape(len(rows), dim)
    scale = np.abs(m).max(axis=1, keepdims=True)
    m = m / scale  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the links (i, j) of n nodes."""
    parent = list(range(n))
    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = a, b
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


class Rows:
    """Classes that meet in some buckets, as arrays."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.cid, self.copies = pdf["cid"].to_numpy(), pdf["copies"].to_numpy()
        self.unit, self.keys = list(pdf["unit"]), np.stack(pdf["keys"])

    def met_before(self, a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
        """Whether pairs meet in a bucket of an earlier table."""
        return (self.keys[a, :table] == self.keys[b, :table]).any(axis=1)

    def compare(self, left: np.ndarray, right: np.ndarray | None, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, list]:
        """Two blocks of a bucket (None: one block in itself): rows, their counts, spanning links.

        A pair counts if no bucket before this one brings it together.
        """
        x = np.stack([self.unit[k] for k in left])
        y = x if right is None else np.stack([self.unit[k] for k in right])
        hit = x @ y.T >= threshold
        i, j = np.nonzero(np.triu(hit, 1) if right is None else hit)
        a, b = left[i], (left if right is None else right)[j]
        fresh = np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            fresh[s] = ~self.met_before(a[s], b[s], table)
        both = left if right is None else np.concatenate([left, right])
        count = np.zeros(len(both), np.int64)
        shift = 0 if right is None else len(left)
        np.add.at(count, i[fresh], self.copies[b[fresh]])
        np.add.at(count, j[fresh] + shift, self.copies[a[fresh]])
        links = [(int(both[p]), int(both[q])) for p, q in _spanning(len(both), i, j + shift)]
        return both[count > 0], count[count > 0], links


def compare_buckets(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Counts (other null) and links of all buckets and block pairs of a group of rows."""
    pdf = pdf.sort_values(["t", "label", "key", "p", "q", "blk", "cid"], ignore_index=True)
    rows, n = Rows(pdf), len(pdf)
    change = np.zeros(n, bool)
    change[0] = True
    for c in ("t", "label", "key", "p", "q"):
        v = pdf[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(change)
    table, p, q, blk = (pdf[c].to_numpy() for c in ("t", "p", "q", "blk"))
    count, links = np.zeros(n, np.int64), []
    for a, b in zip(at.tolist(), [*at[1:].tolist(), n]):
        here = np.arange(a, b)
        if b - a < 2:
            continue
        if p[a] == q[a]:
            found = rows.compare(here, None, int(table[a]), threshold)
        else:
            left, right = here[blk[here] == p[a]], here[blk[here] == q[a]]
            if not len(left) or not len(right):
                continue
            found = rows.compare(left, right, int(table[a]), threshold)
        count[found[0]] += found[1]
        links += found[2]
    some = np.flatnonzero(count)
    cids, other = [rows.cid[some]], [np.full(len(some), None, object)]
    if links:
        x, y = np.asarray(links).T
        cids.append(rows.cid[x])
        other.append(rows.cid[y].astype(object))
    counts = np.concatenate([count[some], np.zeros(len(links), np.int64)])
    return pd.DataFrame({"cid": np.concatenate(cids), "n": counts, "other": pd.array(np.concatenate(other), dtype="Int64")})


def near(vectors: DataFrame, threshold: float = 0.98, tables: int = 24, depth: int = 8, width: float = 1.0, block: int = 1024, crowd: int = 4096, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    ``crowd`` is taken from older callers and changes nothing: no bucket is hashed anew.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    src = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"), vectors[label_col].cast("string").alias("label"))

    def hashed(batch):
        rows = batch.column(1).to_pylist()
        known = batch.column(2).is_valid().to_pylist()
        good = [bool(k) and _usable(v) for v, k in zip(rows, known)]
        unit, keys = [None] * len(rows), [None] * len(rows)
        for dim in {len(rows[i]) for i in range(len(rows)) if good[i]}:
            at = [i for i in range(len(rows)) if good[i] and len(rows[i]) == dim]
            m = _matrix([rows[i] for i in at], dim)
            for i, u, k in zip(at, m, keys_of(m, tables, depth, width, seed)):
                unit[i], keys[i] = u, k
        same = [None if v is None else vt.word_hash(np.asarray(v, np.float64).tobytes()) - (1 << 63) if g else None for v, g in zip(rows, good)]
        yield {"vec_id": batch.column(0), "label": batch.column(2), "same": same, "unit": unit, "keys": keys}

    all_ = scratch.table(map_docs(src, hashed, f"vec_id {ddl(src, 'vec_id')}, label string, same long, unit array<double>, keys array<long>"))
    # A class is the equal vectors of a label; cid names it.
    usable = all_.where("same is not null").withColumn("cid", F.xxhash64("label", "same"))
    classes = scratch.table(usable.groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("label", "unit", "keys"), "same").alias("x")).select("cid", "rep", "copies", "x.*"))
    filed = classes.select("cid", "label", F.posexplode("keys").alias("t", "key"))
    # Only buckets with company go on, and of buckets with the same classes the first.
    size = filed.groupBy("t", "label", "key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor("cid").alias("s"), F.bit_xor(F.xxhash64("cid")).alias("x")).where("m > 1")
    first = size.groupBy("label", "m", "s", "x").agg(F.min(F.struct("t", "key")).alias("f"))
    buckets = scratch.table(first.select("f.t", "label", "f.key", "m"))
    placed = filed.join(buckets, ["t", "label", "key"]).withColumn("blocks", F.expr(f"cast(ceil(m / {block}) as int)")).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # A block meets itself and each later one: pair (p, q) takes blocks p and q.
    pairs = placed.withColumn("pair", F.expr("explode(transform(sequence(0, blocks - 1), o -> struct(least(o, blk) as p, greatest(o, blk) as q)))"))
    pairs = scratch.table(pairs.select("cid", "t", "label", "key", "blk", "pair.p", "pair.q"))
    groups = int(min(1 << 20, max(8, -(-pairs.count() // 4096))))  # of buckets, about 4096 rows each
    known = classes.select("cid", "copies", "unit", "keys")
    with_units = pairs.join(known, "cid").withColumn("g", F.pmod(F.xxhash64("t", "label", "key", "p", "q"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return compare_buckets(pdf, threshold)

    found = scratch.table(with_units.groupBy("g").applyInPandas(run, "cid long, n long, other long"))
    scratch.drop(pairs)
    counts = found.where("other is null").groupBy("cid").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")), scratch)
    of_class = classes.select("cid", "rep", "copies").join(counts, "cid", "left").join(components, F.col("cid") == F.col("node"), "left")
    of_class = scratch.table(of_class.select("cid", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")))
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = scratch.table(of_class.join(least, "component").select("cid", "n_links", "component_id"))
    out = all_.select("vec_id", F.when(F.col("same").isNotNull(), F.xxhash64("label", "same")).alias("cid")).join(of_class, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
