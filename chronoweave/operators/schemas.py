"""Unions of tables that follow a report on their columns, made before any row is read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.sources.store import checkpointed

#: Names of a label column, the first that is there counts.
LABELS = ("GroundTruth", "label", "prediction", "target")
#: What a column is, by the first of these that its name holds; the most specific stand first.
KINDS = (
    ("Hist_Dist", "histogram comparison"), ("Histogram_Dist", "histogram comparison"), ("Hist", "histogram"), ("Edge", "edge density"), ("SSIM", "structural similarity"), ("Text", "text occupancy"),
    ("Brightness", "brightness"), ("Contrast", "contrast"), ("Entropy", "entropy"), ("Difference", "pixel difference"),
)


@dataclass(frozen=True)
class Report:
    """What tables have in common; columns keep the order of the table that names them first."""

    common: tuple[str, ...]
    every: tuple[str, ...]
    missing: dict[str, tuple[str, ...]]
    conflicts: dict[str, dict[str, str]]
    labels: dict[str, str | None]

    @property
    def compatible(self) -> bool:
        return not self.conflicts

    @property
    def identical(self) -> bool:
        return self.common == self.every and self.compatible


def label_of(df: DataFrame) -> str | None:
    """The label column of a table, or None."""
    return next((c for c in LABELS if c in df.columns), None)


def compatibility(tables: Mapping[str, DataFrame]) -> Report:
    """The report on some tables' columns; types conflict where Spark would not bring them together as numbers."""
    if not tables:
        raise ValueError("a report needs a table")
    order = list(dict.fromkeys(c for t in tables.values() for c in t.columns))
    held = {n: set(t.columns) for n, t in tables.items()}
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kinds = {c: {n: dict(t.dtypes)[c] for n, t in tables.items() if c in held[n]} for c in order}
    clash = {c: k for c, k in kinds.items() if len(set(k.values())) > 1 and not set(k.values()) <= numbers}
    return Report(tuple(c for c in order if all(c in h for h in held.values())), tuple(order), {n: tuple(c for c in order if c not in h) for n, h in held.items()}, clash, {n: label_of(t) for n, t in tables.items()})


def combine(tables: Mapping[str, DataFrame], report: Report, how: str = "common", tag: str = "source", fill: object = None) -> DataFrame:
    """All rows of the tables with ``common`` or ``all`` columns and the table's name in ``tag``.

    Missing columns are null, or ``fill`` where that is given and fits the type; tables whose
    types conflict in a column that is kept are refused.
    """
    if how not in ("common", "all"):
        raise ValueError("how is common or all")
    kept = report.common if how == "common" else report.every
    if bad := [c for c in kept if c in report.conflicts]:
        raise ValueError(f"types differ in {', '.join(bad)}")
    if tag in kept:
        raise ValueError(f"{tag} is a column already")
    parts = [t.select(*[c for c in kept if c in t.columns], F.lit(n).alias(tag)) for n, t in tables.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*kept, tag)
    if fill is not None:
        for n, gone in report.missing.items():
            out = out.withColumns({c: F.when((F.col(tag) == n) & F.col(c).isNull(), F.lit(str(fill)).try_cast(out.schema[c].dataType)).otherwise(F.col(c)) for c in gone if c in kept})
    return out


def first_of_equal(df: DataFrame, tag: str, order: Sequence[str]) -> DataFrame:
    """One row of those that agree in all columns but ``tag``: that of the tag that stands first in ``order``.

    Only the place of a tag is aggregated, so a row that a third of the table
    repeats is summed up before it is shuffled.
    """
    place = F.coalesce(*[F.when(F.col(tag) == t, F.lit(i)) for i, t in enumerate(order)], F.lit(len(order)))
    rest = [c for c in df.columns if c != tag]
    best = df.groupBy(*rest).agg(F.min(F.struct(place.alias("at"), F.col(tag).alias("tag"))).alias("__t"))
    return best.select(*rest, F.col("__t.tag").alias(tag)).select(*df.columns)


def numbered(df: DataFrame, order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds 1..n in an order, without a window over all rows: ranges are sorted side by side and begin where the one before ends.

    Rows that are equal in ``order`` are told apart by the other columns.
    """
    keys = [*order, *[c for c in df.columns if c not in order]]
    spread = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    d = checkpointed(spread.withColumn("__part", F.spark_partition_id()))  # ranges are drawn from a sample: they are fixed before they are counted
    w = Window.partitionBy("__part").orderBy(*keys)
    d = d.withColumn("__at", F.row_number().over(w))
    size = d.groupBy("__part").agg(F.max("__at").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    first = size.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return d.join(F.broadcast(first), "__part").withColumn(name, (F.col("__base") + F.col("__at")).cast("long")).drop("__part", "__at", "__base")


def deltas(columns: Sequence[str]) -> list[str]:
    """Columns that tell of a pair: those of one frame and the label go."""
    return [c for c in columns if not c.startswith(("FrameA_", "FrameB_")) and c != "GroundTruth"]


def pruned(columns: Sequence[str]) -> list[str]:
    """The short list: differences, Bhattacharyya distances and structural similarity."""
    return [c for c in columns if any(s in c for s in ("Diff", "Bhattacharyya", "SSIM_"))]


def kind(column: str) -> str:
    """What a column is, by its name."""
    return next((k for s, k in KINDS if s.lower() in column.lower()), "other")
