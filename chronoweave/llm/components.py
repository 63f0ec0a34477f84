"""Connected components of a link table, by alternating star contractions.

Each round replaces the links by links to the smallest neighbour (first for
larger neighbours, then for smaller ones) and writes them to the shared
folder; after O(log n) rounds every node hangs on the smallest id of its
component.  No component is ever gathered in one task: rounds only take
minima, which Spark combines before shuffling, and joins of the links with
these minima.  Nodes with very many links (hubs) get their minimum by
broadcast, so their links are never dealt to one task; a node is a hub if it
has more than a fixed part of all links, so there are at most ``HUBS`` a
partition, however large the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Scratch

HUBS = 8
LEAST = 128  # links that no hub falls short of


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _with_least(links: DataFrame, key: str, value: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """The links with the least value of their key as ``m``; and the minima alone (key, m)."""
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = max(LEAST, rows // (HUBS * parts))
    least = links.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("deg"))
    hubs = least.where(F.col("deg") > often).select(key, F.col("m").alias("hub_m"))  # at most HUBS * parts rows
    marked = links.join(F.broadcast(hubs), key, "left")
    few = marked.where("hub_m is null").drop("hub_m").join(least.where(F.col("deg") <= often).select(key, "m"), key)
    many = marked.where("hub_m is not null").withColumnRenamed("hub_m", "m")
    return few.unionByName(many), least.select(key, "m")


def connected_components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """node, component (the smallest reachable id) for all nodes with a link to another node."""
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    now = scratch.table(links.where(F.col(a) != F.col(b)).select(hi, lo).distinct())
    seen = _mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large, _ = _with_least(both, "u", "v", 2 * seen[0])
        large = scratch.table(large.where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct())
        small, least = _with_least(large, "hi", "lo", seen[0])
        small = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = scratch.table(small.union(least.select("hi", F.col("m").alias("lo"))).distinct())
        mark = _mark(new)
        scratch.drop(now, large)
        now = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
