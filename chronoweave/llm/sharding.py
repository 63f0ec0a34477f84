"""Sharding by proportional stratified interleaving (DataFrame functions only).

The rows of every source are shuffled by a seeded hash and ranked; a row's
fractional rank, (rank + 1/2) / rows of the source, spreads each source evenly
over [0, 1).  In the order of fractional ranks any stretch of rows has the
mixture of the whole, so cutting that order into equal stretches gives shards
that match the mixture to within one row a source.

Law ``rows``: the sizes of the shards differ by one row at most.

Both rankings go through ``ranking.ranked``: a source that holds most rows is
ranked in many tasks.  Only ids, sizes and checksums are shuffled, never texts.
Null sources are a stratum of their own; null text counts as empty; repeated
rows are rows; empty input gives no rows.  Extra columns are ignored.  Equal
fractional ranks are ordered by the hash, then source, id, checksum and size;
rows equal in all of these take their places in any order.  Of a very long text
only size and checksum are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import ranking

#: Fractional ranks are compared as integers below 2**FRACTION_BITS.
FRACTION_BITS = 52


def shard(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_bucket: int = 20_000) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard (null).

    ``slot`` counts the rows of a shard from 0 in interleaved order.
    """
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = docs.count()
    buckets = ranking.bucket_count(rows, rows_per_bucket)
    d = docs.select(
        docs[id_col].alias("doc_id"),
        docs[source_col].alias("source"),
        F.when(docs[source_col].isNull(), "0").otherwise(F.concat(F.lit("1"), docs[source_col].cast("string"))).alias("__cw_source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        ranking.spread(docs[id_col], seed=seed).alias("__cw_at"),
    )
    ties = ["doc_id", "text_crc32", "size"]
    d = ranking.ranked(d, "__cw_source", "__cw_at", ties, buckets, rank="__cw_rank", total="__cw_total")
    fraction = F.floor((F.col("__cw_rank") + 0.5) / F.col("__cw_total") * F.lit(1 << FRACTION_BITS)).cast("long")
    d = d.withColumn("__cw_fraction", fraction).withColumn("__cw_all", F.lit(0))
    d = ranking.ranked(d, "__cw_all", "__cw_fraction", ["__cw_at", "__cw_source", *ties], buckets, 1 << FRACTION_BITS, rank="__cw_place")
    # Shard s begins at place ceil(s * rows / shards).
    n = max(rows, 1)
    d = d.withColumn("__cw_shard", F.expr(f"(__cw_place * {shards}L) div {n}L"))
    begin = F.expr(f"(__cw_shard * {n}L + {shards - 1}L) div {shards}L")
    return d.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__cw_shard").cast("int").alias("shard"),
        (F.col("__cw_place") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

