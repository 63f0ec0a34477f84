"""Areas under curves and classification reports from counts by score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.ranks import with_below


def areas(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: auc, average_precision, positives, negatives; ties count half, null scores and labels are left out.

    Scores are counted and ranked range by range, so no task sorts all scores.
    Where there is only one label, both areas are null.
    """
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    y = (F.col(label) == 1).cast("long")
    c = d.groupBy(F.col(score).cast("double").alias("x")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    ends = c.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    c = with_below(c, [], "x", ["p", "n"]).crossJoin(F.broadcast(ends))  # one row is broadcast
    at_least = (F.col("all_p") - F.col("below_p")).cast("double")
    everyone = F.col("all_p") + F.col("all_n") - F.col("below_p") - F.col("below_n")
    t = c.agg(
        F.sum(F.col("p") * (F.col("below_n") + F.col("n") / 2)).alias("a"), F.sum(F.col("p") * at_least / everyone).alias("ap"), F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("negatives")
    )
    some = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return t.select(F.when(some, F.col("a") / (F.col("positives").cast("double") * F.col("negatives"))).alias("auc"), F.when(some, F.col("ap") / F.col("positives")).alias("average_precision"), "positives", "negatives")


def report(df: DataFrame, label: str, score: str, thresholds: Sequence[float] = (0.5,)) -> DataFrame:
    """threshold, class, precision, recall, f1, support: both classes, macro avg, weighted avg and accuracy.

    All thresholds are counted in one pass; ratios without a denominator are 0.
    """
    y, x = F.col(label), F.col(score)
    n = lambda c: F.count_if(c)
    sums = df.where(y.isNotNull() & x.isNotNull()).agg(*[F.struct(F.lit(float(t)).alias("threshold"), n((x >= t) & (y == 1)).alias("tp"), n((x >= t) & (y == 0)).alias("fp"), n((x < t) & (y == 1)).alias("fn"), n((x < t) & (y == 0)).alias("tn")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    c = sums.select(F.explode(F.array(*[f"t{i}" for i in range(len(thresholds))])).alias("c")).select("c.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    one = lambda name, hit, said, own: F.struct(F.lit(name).alias("class"), ratio(hit, said).alias("precision"), ratio(hit, own).alias("recall"), ratio(2 * hit, said + own).alias("f1"), own.alias("support"))
    c = c.select("threshold", one("0", tn, tn + fn, tn + fp).alias("k0"), one("1", tp, tp + fp, tp + fn).alias("k1"), (tp + tn).alias("right"), (tp + fp + fn + tn).alias("n"))
    both = ("precision", "recall", "f1")
    macro = F.struct(F.lit("macro avg").alias("class"), *[((F.col(f"k0.{m}") + F.col(f"k1.{m}")) / 2).alias(m) for m in both], F.col("n").alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("class"), *[ratio(F.col(f"k0.{m}") * F.col("k0.support") + F.col(f"k1.{m}") * F.col("k1.support"), F.col("n")).alias(m) for m in both], F.col("n").alias("support"))
    right = F.struct(F.lit("accuracy").alias("class"), *[ratio(F.col("right"), F.col("n")).alias(m) for m in both], F.col("n").alias("support"))
    return c.select("threshold", F.explode(F.array("k0", "k1", macro, weighted, right)).alias("r")).select("threshold", "r.*")
