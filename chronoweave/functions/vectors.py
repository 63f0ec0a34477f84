"""Vector functions as Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """a / |a|, or a itself if its norm is at most 1e-9."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 1e-9, x.cast("double") / n).otherwise(x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """(1 - cosine) / 2 clipped to [0, 1], 4 decimals; null if one is missing."""
    cos = dot(a, b) / ((norm(a) + 1e-9) * (norm(b) + 1e-9))
    return F.when(cos.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - cos) / 2)), 4))


def tile_ssim_distance(a: Column, b: Column, side: int = 8, window: int = 7, span: float = 255.0) -> Column:
    """1 - mean structural similarity of two gray tiles of side x side, clipped to [0, 1], 4 decimals; 1 if one is missing.

    Uniform windows with sample covariance, as of the kernel for whole images;
    pixels are whole numbers, so all sums are exact.
    """
    n = float(window * window)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    offsets = [[(y + dy) * side + x + dx for dy in range(window) for dx in range(window)] for y in range(side - window + 1) for x in range(side - window + 1)]

    def similarity(at: Column) -> Column:
        zero = F.lit(0.0)
        start = F.struct(*[zero.alias(k) for k in ("x", "y", "xx", "yy", "xy")])

        def add(s, i):
            x, y = a[i], b[i]
            return F.struct((s["x"] + x).alias("x"), (s["y"] + y).alias("y"), (s["xx"] + x * x).alias("xx"), (s["yy"] + y * y).alias("yy"), (s["xy"] + x * y).alias("xy"))

        def value(s):
            mx, my = s["x"] / n, s["y"] / n
            k = n / (n - 1)
            vx, vy, vxy = k * (s["xx"] / n - mx * mx), k * (s["yy"] / n - my * my), k * (s["xy"] / n - mx * my)
            return ((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))

        return F.aggregate(at, start, add, value)

    windows = F.array(*[F.array(*[F.lit(i) for i in o]) for o in offsets])
    mean = F.aggregate(F.transform(windows, similarity), F.lit(0.0), lambda s, x: s + x) / len(offsets)
    whole = (F.size(a) == side * side) & (F.size(b) == side * side)
    return F.when(F.coalesce(whole, F.lit(False)), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean)), 4)).otherwise(F.lit(1.0))


def unit_distance(a: Column, b: Column) -> Column:
    """(1 - a . b) / 2 clipped to [0, 1], for unit vectors; 0 if one is missing."""
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - dot(a, b)) / 2))), F.lit(0.0))


def is_histogram(h: Column, near: float = 1e-5) -> Column:
    """Whether all numbers are finite and not negative and sum to 1; null is no histogram."""
    good = ~F.exists(h, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")))
    return F.coalesce(good & (F.abs(F.aggregate(h, F.lit(0.0), lambda s, x: s + x.cast("double")) - 1) <= near), F.lit(False))
