"""SimHash near-dedup with multi-index hashing.

A fingerprint bit is 1 if it is set in over half the XXH64 values of a text's
word shingles.  Two fingerprints link at ``radius`` or fewer differing bits.
The 64 bits fall into two segments of 32; of two fingerprints within 3 bits,
one segment differs by at most one bit.  Every fingerprint is therefore filed
under its two segments and looks up the Hamming ball of radius 1 around each.
One half of the ball is enough: of two values one bit apart, clearing that bit
in the one gives the other, so only cleared bits are enumerated and each pair
is met once.  Complete distances are verified on the matches.

Equal fingerprints are one class, filed once however many texts share it.  A
segment value that very many classes share is split further by the bytes of
the other segment (within 3 bits, one of four bytes is equal), which loses no
pair.  Links join classes; components spread over links.

Null text counts as empty; texts without a word have the fingerprint zero,
which links like any other.  Repeated rows are in one class.  Empty input
gives no rows.  Extra columns are ignored.  A bit that exactly half the values
have is 0.  A very long text is hashed whole by one task, whose memory follows
its length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import vector_text as vt
from chronoweave.llm.common import Scratch, ddl, id_text, map_docs, rows_in
from chronoweave.llm.components import connected_components
from chronoweave.llm.xxh import xxh64


def of_words(w: vt.Words, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (uint64) of the texts of ``w``."""
    out = np.zeros(len(w.counts), np.uint64)
    has = np.flatnonzero(w.counts)
    if not len(has):
        return out
    data, a, b = w.joined()
    count = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(bounds[-1]) + np.repeat(w.first[:-1] - bounds[:-1], count)
    to = np.minimum(k + shingle - 1, np.repeat(w.first[1:] - 1, count))
    values = xxh64(data, a[k], b[to], seed)
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, bounds[:-1][has], axis=0, dtype=np.int32)
    major = ones * 2 > count[has, None]
    out[has] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint of every whole text, as a signed long."""
    df = id_text(docs, id_col, text_col)

    def run(batch):
        for part in rows_in([batch], 400_000):
            yield {"doc_id": part.column(0), "fp": of_words(vt.Words(part.column(1)), shingle, seed).view(np.int64)}

    return map_docs(df, run, f"doc_id {ddl(df, 'doc_id')}, fp long")


def _filed(classes: DataFrame, ball: int) -> DataFrame:
    """seg, val, fp, rep: each class under its segments, or under the cleared-bit balls around them."""
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    both = classes.select("fp", "rep", F.expr(f"explode(array(struct(0 as seg, {low} as val), struct(1 as seg, {high} as val)))").alias("s")).select("fp", "rep", "s.seg", "s.val")
    if not ball:
        return both
    cleared = "transform(filter(sequence(0, 31), i -> (shiftright(val, i) & 1L) = 1L), i -> val & ~shiftleft(1L, i))"
    return both.withColumn("val", F.expr(f"explode(concat(array(val), {cleared}))"))


def _split(filed: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Adds the columns sub and part of the key; crowded values are split by the other segment's bytes."""
    plain = filed.withColumn("sub", F.lit(-1)).withColumn("part", F.lit(0).cast("long"))
    if crowded is None:
        return plain
    rest = "if(seg = 0, shiftrightunsigned(fp, 32), fp & 4294967295L)"
    parts = F.expr(f"explode(transform(sequence(0, 3), i -> struct(i as sub, shiftright({rest}, 8 * i) & 255L as part)))")
    in_crowd = filed.join(crowded, ["seg", "val"], "left_semi").withColumn("p", parts).select(*filed.columns, "p.sub", "p.part")
    return plain.join(crowded, ["seg", "val"], "left_anti").unionByName(in_crowd)


def class_links(classes: DataFrame, scratch: Scratch, radius: int = 3, crowd: int = 512) -> DataFrame:
    """a, b, distance: the links between classes (fp, rep) with different fingerprints."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius 1 find up to 3 differing bits")
    filed = _filed(classes, 0)
    crowded = scratch.table(filed.groupBy("seg", "val").count().where(F.col("count") > crowd).select("seg", "val"))
    full = None if crowded.isEmpty() else crowded
    table = _split(filed, full).select("seg", "val", "sub", "part", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    probes = _split(_filed(classes, 1), full)
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    met = probes.join(table, ["seg", "val", "sub", "part"]).where((F.col("fp") != F.col("fp2")) & (distance <= radius))
    return met.select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b"), distance.alias("distance")).distinct()


def cluster(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), class_id, component_id for every row.

    class_id: the smallest doc_id with the same fingerprint; component_id: the
    smallest doc_id that links reach.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(fingerprints(docs, shingle, seed, id_col, text_col))
    classes = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    components = connected_components(class_links(classes, scratch, radius), scratch)
    of_class = classes.join(components, classes["rep"] == components["node"], "left").select("fp", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "class_id", "component_id")


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of each component, all columns kept.

    Of rows that repeat an id, the one with the smallest text stays; rows
    without an id stay only if nothing links to them.
    """
    return keep_found(docs, cluster(docs, radius, shingle, seed, id_col, text_col), id_col, text_col)


def keep_found(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose doc_id is the component_id that was found for it."""
    keep = Scratch(docs.sparkSession, "kept").table(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("__cw_rows")))
    once = keep.select(F.col("doc_id").alias("__cw_id"), "__cw_rows")
    # The kept ids grow with the input: never broadcast, so every size has this plan.
    out = docs.join(once.hint("merge"), docs[id_col].eqNullSafe(once["__cw_id"])).drop("__cw_id")
    if not keep.where("__cw_rows > 1").isEmpty():
        from pyspark.sql import Window

        order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_first())
        out = out.withColumn("__cw_k", F.when(F.col("__cw_rows") > 1, F.row_number().over(order)).otherwise(1)).where("__cw_k = 1").drop("__cw_k")
    return out.drop("__cw_rows")
