"""The columns that tell two or more classes apart best, by the F ratio of analysis of variance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def f_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, score: variance between classes over variance within; one pass, a row a class.

    Nulls are left out feature by feature.  The score is null with under two
    classes and infinite where nothing varies within the classes.  Sums are
    taken of values less the feature's mean, so that large values do not cancel.
    """
    d = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    means = d.agg(*[F.avg(c).alias(f"{c}__m") for c in features])
    d = d.crossJoin(F.broadcast(means))  # one row is broadcast
    moved = lambda c: F.col(c) - F.col(f"{c}__m")
    per = d.groupBy("y").agg(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.sum(moved(c)).alias("s"), F.sum(moved(c) * moved(c)).alias("q")).alias(f"x{i}") for i, c in enumerate(features)])
    per = per.select("y", F.explode(F.array(*[f"x{i}" for i in range(len(features))])).alias("x")).select("y", "x.*").where("n > 0")
    t = per.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return t.select("feature", F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), F.when(within > 0, between / within).otherwise(F.lit(float("inf")))).alias("score"))


def select_k_best(df: DataFrame, features: Sequence[str], label: str, k: int) -> list[str]:
    """The k features of the highest scores, best first; ties go to the one named first.  A score a feature reaches the driver."""
    found = {r["feature"]: r["score"] for r in f_scores(df, features, label).collect()}
    order = sorted(range(len(features)), key=lambda i: (-(found.get(features[i]) if found.get(features[i]) is not None else -1.0), i))
    return [features[i] for i in order[:k]]
