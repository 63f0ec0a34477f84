"""Seeded splits that keep the mixture of strata exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.ranks import with_below


def lot(key: Column, seed: int) -> Column:
    """A whole number below 2**52 that a key draws with a seed; null keys draw as the empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def stratified(df: DataFrame, stratum: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``test``: 1 for the rows of each stratum with the smallest lots, ``share`` of them (rounded half up), else 0.

    Lots are ranked range by range, so a stratum of any size is no single task;
    rows of one key share their lot and go the same way.  A null stratum is one
    of its own.
    """
    d = df.withColumn("__lot", lot(F.col(key), seed))
    counts = d.groupBy(F.col(stratum).alias("__s"), "__lot").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(F.struct("__s").alias("__k")).agg(F.sum("n").alias("__total"))
    ranked = with_below(counts, ["__s"], "__lot", ["n"]).withColumn("__k", F.struct("__s")).join(total, "__k")
    chosen = ranked.where(F.col("below_n") < F.floor(F.col("__total") * share + 0.5)).select("__k", "__lot", F.lit(1).alias("__in"))
    d = d.withColumn("__k", F.struct(F.col(stratum).alias("__s")))
    return d.join(chosen, ["__k", "__lot"], "left").withColumn("test", F.coalesce("__in", F.lit(0))).drop("__k", "__lot", "__in")
