"""Exact ranks and quantiles of any number of values: counted first, then summed up range by range.

Values are counted (so a value that most rows have is one row), cut into ranges
that hold about as many distinct values each, and every range is summed in a
task of its own; what lies below it comes from a table of one row a range.  No
task sorts or holds all distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_below(counts: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], ranges: int = 64) -> DataFrame:
    """Adds below_<sum> for each of the sums: its total over the rows of the same ``by`` with smaller values.

    ``counts`` has a row for each (by, value), without nulls in ``value``.  The
    ends of ranges are estimated by a sketch of bounded size; they only deal out
    the work.
    """
    ranges = max(ranges, 2)
    c = counts.withColumn("__key", F.struct(*by) if by else F.lit(0))  # a struct matches where a null stands in it
    ends = c.groupBy("__key").agg(F.percentile_approx(value, [(i + 1) / ranges for i in range(ranges - 1)], 20 * ranges).alias("__ends"))
    at = lambda e: F.size(F.filter(e, lambda x: x < F.col(value)))
    c = c.join(F.broadcast(ends) if not by else ends, "__key").withColumn("__range", at(F.col("__ends"))).drop("__ends")  # one row is broadcast
    whole = c.groupBy("__key", "__range").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    whole = whole.select("__key", "__range", *[F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__{s}") for s in sums])
    inside = Window.partitionBy("__key", "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    c = c.join(whole, ["__key", "__range"]).select("*", *[(F.col(f"__{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"below_{s}") for s in sums])
    return c.drop("__range", "__key", *[f"__{s}" for s in sums])


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, feature, q (an array, one value a share): exact quantiles, between two values by their distance.

    Nulls and NaN are left out; a feature without a value gives no row.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")
    d = df.select(*by, each).select(*by, "f.feature", "f.x").where("x is not null and not isnan(x)")
    keys = [*by, "feature"]
    c = d.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy(F.struct(*keys).alias("__k")).agg(F.sum("n").alias("total"))
    c = with_below(c, keys, "x", ["n"]).withColumn("__k", F.struct(*keys)).join(total, "__k")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("below_n") <= place) & (place < F.col("below_n") + F.col("n")), F.col("x")))

    last = F.col("total") - 1
    ends = [e for i, p in enumerate(shares) for e in (at(F.floor(last * p)).alias(f"lo{i}"), at(F.ceil(last * p)).alias(f"hi{i}"))]
    found = c.groupBy(*keys, "total").agg(*ends)
    between = lambda i, p: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (last * p - F.floor(last * p))
    return found.select(*keys, F.array(*[between(i, p) for i, p in enumerate(shares)]).alias("q"))


def one_row(q: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The quantiles of several features (no ``by``) as one row of arrays, named as the features; null where a feature had no value."""
    return q.groupBy().agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(c) for c in columns])
