"""Ordered sequences: neighbours, scores, vetoes, islands and summaries.

All windows of a chain share one specification, so Spark shuffles and sorts a
table once.  Sessions are the unit of parallelism.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacent(df: DataFrame, session: str, seq: str, cols: list[str]) -> DataFrame:
    """Pairs (i, i+1) of each session: pair_idx from 1, <col>_a and <col>_b."""
    w = Window.partitionBy(session).orderBy(seq)
    nxt = F.lead(F.struct(*cols)).over(w)
    d = df.select(session, F.row_number().over(w).alias("pair_idx"), *[F.col(c).alias(f"{c}_a") for c in cols], nxt.alias("__n"))
    return d.where("__n is not null").select(session, "pair_idx", *[f"{c}_a" for c in cols], *[F.col(f"__n.{c}").alias(f"{c}_b") for c in cols])


def composite(signals: Mapping[str, tuple[float, Column, Column]]) -> Column:
    """Weighted mean of valid signals {name: (weight, value, valid)}, 4 decimals."""
    num = sum((F.when(ok, w * v).otherwise(0.0) for w, v, ok in signals.values()), F.lit(0.0))
    den = sum((F.when(ok, F.lit(float(w))).otherwise(0.0) for w, _, ok in signals.values()), F.lit(0.0))
    return F.round(num / F.greatest(den, F.lit(1e-9)), 4)


def islands(df: DataFrame, session: str, seq: str, split_after: str) -> DataFrame:
    """group_id = 1 + the number of splits before the row."""
    w = Window.partitionBy(session).orderBy(seq)
    d = df.withColumn("__s", F.coalesce(F.lag(split_after).over(w), F.lit(0)))
    run = F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn("group_id", (1 + run).cast("long")).drop("__s")


def group_summary(df: DataFrame, session: str, seq: str, seconds: str) -> DataFrame:
    """Size, ends and duration of each group."""
    return df.groupBy(session, "group_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.min_by(seq, seq).alias("start_seq"), F.max_by(seq, seq).alias("end_seq"),
        F.greatest(F.lit(0), F.max_by(seconds, seq) - F.min_by(seconds, seq)).cast("long").alias("duration_sec"),
    )


def bridge(df: DataFrame, session: str, seq: str, tokens: str, pred: str, more: int = 8, overlap: float = 0.5) -> DataFrame:
    """Clears the split that leaves a transient pop-up: a frame with far more tokens than both neighbours, which agree."""
    w = Window.partitionBy(session).orderBy(seq)
    before, after = F.lag(tokens).over(w), F.lead(tokens).over(w)
    d = df.select("*", before.alias("__p"), after.alias("__n"))
    size = F.size(tokens)
    share = F.size(F.array_intersect("__p", "__n")) / F.size(F.array_distinct("__p"))
    pop = (size > F.size("__p") + more) & (size > F.size("__n") + more) & (F.size("__p") > 0) & (share >= overlap)
    return d.withColumn(pred, F.when(F.coalesce(pop, F.lit(False)), 0).otherwise(F.col(pred))).drop("__p", "__n")


def boilerplate(df: DataFrame, session: str, tokens: str, share: float = 0.7) -> DataFrame:
    """(session, tok, df): tokens of at least ``share`` of the session's frames."""
    n = df.groupBy(session).agg(F.count(F.lit(1)).alias("n"))
    t = df.select(session, F.explode(F.array_distinct(tokens)).alias("tok")).groupBy(session, "tok").agg(F.count(F.lit(1)).alias("df"))
    return t.join(n, session).where(F.col("df") / F.col("n") >= share).select(session, "tok", "df")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def confusion(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 over labelled rows."""
    def n(p: int, y: int) -> Column:
        return F.sum(((F.col(pred) == p) & (F.col(label) == y)).cast("long"))

    d = df.where(F.col(label).isNotNull()).groupBy(*(by or [])).agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"), n(0, 0).alias("tn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return d.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def normalise_quality(df: DataFrame, session: str, value: str, q_min: float = 0.2) -> DataFrame:
    """Adds p5, p95 and the clipped percentile-normalised quality (6 decimals)."""
    p = df.groupBy(session).agg(F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).alias("__p")).select(session, F.col("__p")[0].alias("p5"), F.col("__p")[1].alias("p95"))
    share = (F.col(value) - F.col("p5")) / F.greatest(F.col("p95") - F.col("p5"), F.lit(1e-6))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return df.join(p, session).withColumn("quality", F.round(q_min + (1 - q_min) * clipped, 6))
