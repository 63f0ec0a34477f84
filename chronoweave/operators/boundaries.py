"""Session classes and the boundary rules that correct a session's splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A boilerplate token with one of these marks an editor's window.
CHROME = ("terminal", "console", "todo", "run", "pycharm", "vscode", "main", "py")


def session_class(boilerplate: Column) -> Column:
    """ide, blackboard or slides, from the array of a session's boilerplate tokens."""
    marked = F.exists(boilerplate, lambda t: F.lower(t).rlike("|".join(CHROME)))
    n = F.size(F.coalesce(boilerplate, F.array().cast("array<string>")))
    return F.when((n >= 5) & marked, "ide").when(n <= 2, "blackboard").otherwise("slides")


def resets(df: DataFrame, session: str, seq: str, count: str, back: int = 3, low: int = 1, high: int = 4) -> DataFrame:
    """Adds reset: the count falls to ``low`` or less after ``high`` or more in the ``back`` rows before."""
    w = Window.partitionBy(session).orderBy(seq)
    return df.withColumn("reset", F.coalesce((F.col(count) <= low) & (F.max(count).over(w.rowsBetween(-back, -1)) >= high), F.lit(False)))


def spaced(df: DataFrame, session: str, place: str, flag: str, gap: int = 6) -> DataFrame:
    """(session, place) of the flagged rows kept so that each is ``gap`` or more places after the last kept.

    Place 0 counts as kept.  Only flagged places are gathered, a session at a
    time; the fold runs inside the JVM.
    """
    flagged = df.where(F.col(flag) & (F.col(place) > 0)).groupBy(session).agg(F.sort_array(F.collect_list(F.col(place).cast("long"))).alias("__at"))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<long>").alias("kept"))
    step = lambda s, p: F.when(p - s["last"] >= gap, F.struct(p.alias("last"), F.concat(s["kept"], F.array(p)).alias("kept"))).otherwise(s)
    return flagged.select(session, F.explode(F.aggregate("__at", start, step, lambda s: s["kept"])).alias(place))


def correct(df: DataFrame, session: str, seq: str, pred: str, kind: str, boxes: str, contained: str, gap: int = 6, share: float = 0.7) -> DataFrame:
    """Splits after the rule of the session's class.

    ide: only canvas resets, ``gap`` apart, split (the row before a reset gets
    the split); blackboard: a split whose next frame lies within this one by
    ``share`` or more goes; slides: unchanged.
    """
    w = Window.partitionBy(session).orderBy(seq)
    d = resets(df.withColumn("__place", F.row_number().over(w) - 1), session, seq, boxes)
    cut = spaced(d.where(F.col(kind) == "ide"), session, "__place", "reset", gap).select(F.col(session).alias("__s"), (F.col("__place") - 1).alias("__at"))
    d = d.join(cut, (F.col(session) == F.col("__s")) & (F.col("__place") == F.col("__at")), "left")
    fixed = (
        F.when(F.col(kind) == "ide", F.col("__at").isNotNull().cast("int"))
        .when((F.col(kind) == "blackboard") & (F.coalesce(F.col(contained), F.lit(0.0)) >= share), 0)
        .otherwise(F.col(pred))
    )
    return d.withColumn(pred, fixed).drop("__place", "__s", "__at", "reset")
