"""Areas of unions of boxes on a raster, as Column expressions.

A box is [x1, y1, x2, y2] with coordinates in [0, 1]; its ends are cut to whole
cells and both ends are filled.  A row of the raster is a set of long bit
masks.  Rows between two ends of boxes are alike, so only one row of each such
slab is made and counted as often as the slab is high: the work follows the
boxes, not the raster, and has at most ``side`` slabs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def hull(polygon: Column) -> Column:
    """The box around a polygon [[x, y], ...]; null if it has no whole point."""
    points = F.filter(F.coalesce(polygon, F.array().cast("array<array<double>>")), lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def whole(boxes: Column) -> Column:
    """The boxes that have four coordinates; null is no box."""
    return F.filter(F.coalesce(boxes, F.array().cast("array<array<double>>")), lambda b: (F.size(b) == 4) & ~F.exists(b, lambda v: v.isNull() | F.isnan(v)))


def _bits(lo: Column, hi: Column) -> Column:
    """A long with the bits lo to hi set (none if lo > hi)."""
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (WORD - 1 - (hi - lo)).cast("int"))
    return F.when(lo > hi, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", ones, lo.cast("int")))


def spans(boxes: Column, side: int = 256) -> Column:
    """array<struct<top, end, w0, w1, ...>>: the rows of each box (``end`` is past the last) and the bits it fills in them."""
    cell = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * side).cast("int")
    last = F.lit(side - 1)

    def one(b):
        left, right = cell(b[0]), F.least(cell(b[2]), last)
        words = [_bits(F.greatest(left - WORD * w, F.lit(0)), F.least(right - WORD * w, F.lit(WORD - 1))).alias(f"w{w}") for w in range(side // WORD)]
        return F.struct(cell(b[1]).alias("top"), (F.least(cell(b[3]), last) + 1).alias("end"), *words)

    return F.filter(F.transform(whole(boxes), one), lambda r: r["top"] < r["end"])


def areas(a: Column, b: Column, side: int = 256) -> Column:
    """struct<a, b, both>: cells of the union of each list of boxes, and cells that both unions fill."""
    words = side // WORD
    zero = F.lit(0).cast("long")

    def row(rows: Column, y: Column) -> Column:
        word = lambda w: F.aggregate(rows, zero, lambda s, r: F.when((r["top"] <= y) & (y < r["end"]), s.bitwiseOR(r[f"w{w}"])).otherwise(s))
        return F.array(*[word(w) for w in range(words)])

    def ones(m: Column) -> Column:
        return reduce(Column.__add__, [F.bit_count(m[w]).cast("long") for w in range(words)])

    def count(ra: Column, rb: Column, cuts: Column) -> Column:
        start = F.struct(zero.alias("a"), zero.alias("b"), zero.alias("both"))

        def add(s, i):
            y, high = cuts[i], cuts[i + 1] - cuts[i]
            masks = lambda p: let(row(rb, y), lambda q: F.struct(
                (s["a"] + high * ones(p)).alias("a"), (s["b"] + high * ones(q)).alias("b"),
                (s["both"] + high * reduce(Column.__add__, [F.bit_count(p[w].bitwiseAND(q[w])).cast("long") for w in range(words)])).alias("both"),
            ))
            return let(row(ra, y), masks)

        return F.when(F.size(cuts) < 2, start).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(cuts) - 2), start, add))

    ends = lambda rows: F.flatten(F.transform(rows, lambda r: F.array(r["top"], r["end"])))
    return let(spans(a, side), lambda ra: let(spans(b, side), lambda rb: let(F.array_sort(F.array_distinct(F.concat(ends(ra), ends(rb)))), lambda cuts: count(ra, rb, cuts))))


def share(part: Column, of: Column) -> Column:
    """part / of, 4 decimals, half up."""
    return F.round(part / of + 1e-9, 4)


def layout_change(a: Column, b: Column, side: int = 256) -> Column:
    """struct<iou, d_iou, preservation, loss, valid, containment> from one layout to the next.

    Both empty: alike.  One empty: no overlap; from an empty layout nothing can
    be lost, so ``valid`` is false.  ``containment`` is the share of the second
    layout that the first one fills, null if the second fills nothing.
    """
    none_a, none_b = F.size(whole(a)) == 0, F.size(whole(b)) == 0

    def from_areas(n):
        either = n["a"] + n["b"] - n["both"]
        iou = F.when(none_a & none_b, 1.0).when(none_a | none_b, 0.0).when(either == 0, 1.0).otherwise(n["both"] / either)
        valid = (none_a & none_b) | (~none_a & (none_b | (n["a"] > 0)))
        kept = F.when(none_a & none_b, 1.0).when(none_a | none_b | (n["a"] == 0), 0.0).otherwise(share(n["both"], n["a"]))
        return F.struct(
            F.round(iou + 1e-9, 4).alias("iou"), F.round(1 - iou + 1e-9, 4).alias("d_iou"), kept.alias("preservation"), F.round(1 - kept, 4).alias("loss"), valid.alias("valid"),
            F.when(n["b"] > 0, n["both"] / n["b"]).alias("containment"),
        )

    return let(areas(a, b, side), from_areas)


def inside(boxes: Column, left: float = 0.08, right: float = 0.95, top: float = 0.08, bottom: float = 0.62) -> Column:
    """How many boxes lie in a region, ends included."""
    return F.size(F.filter(whole(boxes), lambda b: (b[0] >= left) & (b[2] <= right) & (b[1] >= top) & (b[3] <= bottom)))


def area(box: Column) -> Column:
    """The share of the page a box fills; boxes turned over fill nothing."""
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def large(boxes: Column, least: float = 0.02, keep_largest: bool = True) -> Column:
    """The boxes of at least a share of the page; where there is none, the largest (of several the first)."""
    kept = F.filter(whole(boxes), lambda b: area(b) >= least)
    if not keep_largest:
        return kept
    best = F.array_max(F.transform(whole(boxes), area))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(F.filter(whole(boxes), lambda b: area(b) == best), 1, 1))
