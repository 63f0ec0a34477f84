"""Exact ranks without a total sort in one task (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spread values are integers below 2**SPREAD_BITS.
SPREAD_BITS = 31


def spread(*cols: Column, seed: int = 42) -> Column:
    """A uniform integer below 2**31 that depends on the values and the seed alone."""
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << SPREAD_BITS) - 1))


def bucket_count(rows: int, each: int = 20_000, least: int = 64, most: int = 1 << 16) -> int:
    """Buckets so that each holds about ``each`` rows of an even spread."""
    return min(most, max(least, -(-rows // each)))


def ranked(df: DataFrame, key: str, by: str, ties: list[str], buckets: int, width: int = 1 << SPREAD_BITS, rank: str = "rank", total: str | None = None) -> DataFrame:
    """Adds the 0-based rank of each row among those of its key, by (by, ties).

    ``by``: an integer in [0, width), evenly spread; rows are cut by it into
    ``buckets`` buckets a key.  A window ranks within a bucket, and the sums of
    the counts of the buckets before it are added; so no key, however large, is
    sorted in one task.  Rows equal in all of (by, ties) take their ranks in
    any order.  ``total``: a further column, the rows of the key.
    """
    b = "__cw_bucket"
    cut = F.floor(F.col(by) / F.lit(width) * F.lit(buckets)).cast("int")
    d = df.withColumn(b, F.greatest(F.lit(0), F.least(cut, F.lit(buckets - 1))))
    per_key = Window.partitionBy(key).orderBy(b)
    base = d.groupBy(key, b).agg(F.count(F.lit(1)).alias("__cw_n"))
    add = [F.coalesce(F.sum("__cw_n").over(per_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__cw_before")]
    if total:
        add.append(F.sum("__cw_n").over(Window.partitionBy(key)).alias(total))
    base = base.select(key, b, *add)
    inner = Window.partitionBy(key, b).orderBy(by, *ties)
    d = d.withColumn("__cw_row", F.row_number().over(inner))
    return d.join(base, [key, b]).withColumn(rank, F.col("__cw_before") + F.col("__cw_row") - 1).drop(b, "__cw_row", "__cw_before")
