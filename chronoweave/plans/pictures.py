"""Image features on gray tiles: the 64 numbers of an embedding as 8 x 8 pixels; pairs are neighbours of a label.

Every query is one Arrow pass (after one window, where pairs are asked for).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import images as im
from chronoweave.operators import pixels as px
from chronoweave.operators import sequences as sq
from chronoweave.plans.lessons import tile
from chronoweave.plans.registry import query, read

#: Parameters that suit tiles of 8 x 8.
CONFIG = im.Config(blur=3, threshold=90, kernel=3, iterations=1, min_area=10)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.lit(8)
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.struct(side.alias("height"), side.alias("width"), tile(F.col("embedding")).alias("pixels")).alias("image"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.adjacent(tiles(spark, sf_dir), "label", "vec_id", ["vec_id", "image"]).select(F.col("vec_id_a").alias("vec_id"), "image_a", "image_b")


def numbers(df: DataFrame, fields: dict[str, str], places: int = 6) -> DataFrame:
    """Key and rounded numbers {name: expression}."""
    return df.select("vec_id", *[F.round(F.expr(e), places).alias(n) for n, e in fields.items()])


def one(spark, sf, extractor: str, fields: dict[str, str], places: int = 6) -> DataFrame:
    return numbers(im.extract(pairs(spark, sf), ["vec_id"], "image_a", "image_b", CONFIG, {extractor: im.EXTRACTORS[extractor]}), fields, places)


TILES = "t AS (SELECT vec_id, label, list_transform(embedding, lambda x: least(255.0, greatest(0.0, floor((x::DOUBLE + 0.5) * 255)))) AS px FROM embeddings), pr AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM t QUALIFY nxt IS NOT NULL)"
STATS = ("mean", "max", "min", "var", "std")
_AGG = {"mean": "avg", "max": "max", "min": "min", "var": "var_pop", "std": "stddev_pop"}
stats = lambda h, prefix: ", ".join(f"list_aggregate({h}, '{_AGG[s]}') AS {prefix}{s}" for s in STATS)
rounded = lambda names, places=6: ", ".join(f"round({n}, {places}) AS {n}" for n in names)

HIST = f"""gh AS (SELECT vec_id, list_transform(range(64), lambda k: (len(list_filter(px, lambda x: floor(x / 4) = k)) + 1e-10::DOUBLE) / (64 + 64e-10::DOUBLE)) AS h FROM t),
 ch AS (SELECT vec_id, c, list_transform(range(64), lambda k: (len(list_filter([px[i], px[i + 1], px[i + 8], px[i + 9]], lambda x: floor(x / 4) = k)) + 1e-10::DOUBLE) / (4 + 64e-10::DOUBLE)) AS h FROM (SELECT vec_id, px, c, 16 * (c // 4) + 2 * (c % 4) + 1 AS i FROM t, range(16) r(c))),
 gs AS (SELECT vec_id, {stats('h', 'g_')}, {stats('list_transform(list_concat(h, h, h), lambda x: x / 3)', 'c_')} FROM gh),
 cs AS (SELECT vec_id, {', '.join(f"avg(x_{s}) AS grid_{s}" for s in STATS)} FROM (SELECT vec_id, {stats('h', 'x_')} FROM ch) GROUP BY 1)"""


def _compared(a: str, b: str) -> str:
    """SQL of the four comparisons of two lists of 64 shares."""
    m = "0.015625::DOUBLE"
    return f"""list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {m}) * ({b}[i] - {m}))) / sqrt(list_sum(list_transform({a}, lambda x: (x - {m}) * (x - {m}))) * list_sum(list_transform({b}, lambda x: (x - {m}) * (x - {m})))) AS correlation,
 list_sum(list_transform(range(1, 65), lambda i: least({a}[i], {b}[i]))) AS intersection, sqrt(greatest(0, 1 - list_sum(list_transform(range(1, 65), lambda i: sqrt({a}[i] * {b}[i]))))) AS bhattacharyya,
 list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]) / {a}[i])) / 1e9 AS chisquare_g"""


MEASURES = ("correlation", "intersection", "bhattacharyya", "chisquare_g")
_source = lambda m: m.replace("chisquare_g", "chisquare")
_scaled = lambda m, e: f"{e} / 1e9" if m == "chisquare_g" else e


@query("WITH " + TILES + ", " + HIST + " SELECT vec_id, " + rounded([p + s for p in ("g_", "c_") for s in STATS], 8) + " FROM pr JOIN gs USING (vec_id)")
def AG18_histogram_stats(spark, sf):
    """Statistics of the gray histogram (g_) and of the three colours' (c_)."""
    fields = {f"{p}_{s}": f"histogram.a_global_{n}_hist_{s}" for p, n in (("g", "gray"), ("c", "rgb")) for s in STATS}
    e = im.extract(pairs(spark, sf), ["vec_id"], "image_a", "image_b", CONFIG, {"histogram": im.histogram_extractor})
    return numbers(e, fields, 8)


@query("WITH " + TILES + ", " + HIST + ", d AS (SELECT pr.vec_id, a.c, " + _compared("a.h", "b.h") + " FROM pr JOIN ch a ON a.vec_id = pr.vec_id JOIN ch b ON b.vec_id = pr.nxt AND a.c = b.c), e AS (SELECT vec_id, "
       + ", ".join(f"{_AGG[s]}({m}) AS {m}_{s}" for m in MEASURES for s in STATS) + " FROM d GROUP BY 1) SELECT vec_id, " + rounded([f"grid_{s}" for s in STATS]) + ", " + ", ".join(f"round({m}_{s} + 1e-6, 5) AS {m}_{s}" for m in MEASURES for s in STATS) + " FROM e JOIN cs USING (vec_id)")
def AG19_grid_stats(spark, sf):
    """Mean statistics of the cells' histograms, and spread over cells of the four comparisons (chi-square in thousand millions)."""
    e = im.extract(pairs(spark, sf), ["vec_id"], "image_a", "image_b", CONFIG, {"histogram": im.histogram_extractor})
    cells = {f"{m}_{s}": _scaled(m, f"histogram.gray_hist_grid_{s}_{_source(m)}") if s != "var" or m != "chisquare_g" else "histogram.gray_hist_grid_var_chisquare / 1e18" for m in MEASURES for s in STATS}
    return e.select("vec_id", *[F.round(F.expr(f"histogram.a_grid_gray_hist_{s}"), 6).alias(f"grid_{s}") for s in STATS], *[F.round(F.expr(x) + 1e-6, 5).alias(n) for n, x in cells.items()])


_mirror = lambda i: f"(7 - abs(7 - abs({i})))"
_clamp = lambda i: f"least(7, greatest(0, {i}))"
_mag = lambda y, x: f"CASE WHEN y + {y} BETWEEN 0 AND 7 AND x + {x} BETWEEN 0 AND 7 THEN m[(y + {y}) * 8 + x + {x} + 1] ELSE 0 END"
_sum9 = lambda w, at: f"list_sum(list_transform(range(9), lambda q: {w} * {at}))"

EDGES = f"""pix AS (SELECT vec_id, px, p, p // 8 AS y, p % 8 AS x FROM t, range(64) r(p)),
 bl AS (SELECT vec_id, list(v ORDER BY p) AS g FROM (SELECT vec_id, p, ({_sum9("[1, 2, 1][q // 3 + 1] * [1, 2, 1][q % 3 + 1]", f"px[{_mirror('y + q // 3 - 1')} * 8 + {_mirror('x + q % 3 - 1')} + 1]::BIGINT")}::BIGINT + 8) // 16 AS v FROM pix) GROUP BY 1),
 gr AS (SELECT vec_id, p, y, x, {_sum9("[1, 2, 1][q // 3 + 1] * (q % 3 - 1)", f"g[{_clamp('y + q // 3 - 1')} * 8 + {_clamp('x + q % 3 - 1')} + 1]")}::BIGINT AS dx, {_sum9("[1, 2, 1][q % 3 + 1] * (q // 3 - 1)", f"g[{_clamp('y + q // 3 - 1')} * 8 + {_clamp('x + q % 3 - 1')} + 1]")}::BIGINT AS dy
  FROM (SELECT pix.vec_id, p, y, x, g FROM pix JOIN bl USING (vec_id))),
 mg AS (SELECT vec_id, list(abs(dx) + abs(dy) ORDER BY p) AS m FROM gr GROUP BY 1),
 nm AS (SELECT vec_id, p, y, x, abs(dx) + abs(dy) AS s, CASE WHEN abs(dy) * 32768 < abs(dx) * 13573 THEN s > {_mag(0, -1)} AND s >= {_mag(0, 1)} WHEN abs(dy) * 32768 > abs(dx) * 13573 + abs(dx) * 65536 THEN s > {_mag(-1, 0)} AND s >= {_mag(1, 0)}
  WHEN (dx < 0) <> (dy < 0) THEN s > {_mag(-1, 1)} AND s > {_mag(1, -1)} ELSE s > {_mag(-1, -1)} AND s > {_mag(1, 1)} END AS top FROM gr JOIN mg USING (vec_id)),
 wk AS (SELECT vec_id, y, x, s FROM nm WHERE top AND s > 50),
 reach AS (SELECT vec_id, y, x FROM wk WHERE s > 150 UNION SELECT wk.vec_id, wk.y, wk.x FROM reach r JOIN wk ON wk.vec_id = r.vec_id AND abs(wk.y - r.y) <= 1 AND abs(wk.x - r.x) <= 1),
 ed AS (SELECT vec_id, c, count(y) / 4.0::DOUBLE AS d FROM (SELECT vec_id, c FROM t, range(16) q(c)) LEFT JOIN (SELECT vec_id, y, x, (y // 2) * 4 + x // 2 AS c FROM reach) USING (vec_id, c) GROUP BY 1, 2)"""


@query("WITH RECURSIVE " + TILES + ", " + EDGES + """, o AS (SELECT vec_id, avg(d) AS density, max(d) AS grid_max, min(d) AS grid_min, var_pop(d) AS grid_var, stddev_pop(d) AS grid_std FROM ed GROUP BY 1),
 dd AS (SELECT pr.vec_id, avg(abs(a.d - b.d)) AS diff_mean, max(abs(a.d - b.d)) AS diff_max, var_pop(abs(a.d - b.d)) AS diff_var FROM pr JOIN ed a ON a.vec_id = pr.vec_id JOIN ed b ON b.vec_id = pr.nxt AND a.c = b.c GROUP BY 1)
 SELECT vec_id, """ + rounded(["density", "grid_max", "grid_min", "grid_var", "grid_std", "diff_mean", "diff_max", "diff_var"], 8) + " FROM o JOIN dd USING (vec_id)")  # fmt: skip
def F24_AG20_edges(spark, sf):
    """Canny edge densities, whole and by cell, and how they change to the next tile."""
    own = {"density": "edge.a_edge_density", **{f"grid_{s}": f"edge.a_grid_edge_{s}" for s in ("max", "min", "var", "std")}}
    return one(spark, sf, "edge", own | {f"diff_{s}": f"edge.grid_edge_{s}_diff" for s in ("mean", "max", "var")}, 8)


MASK = """px1 AS (SELECT vec_id, p // 8 AS y, p % 8 AS x, CASE WHEN list_avg(px) < 127 THEN px[p + 1] > 165 ELSE px[p + 1] <= 90 END AS on_ FROM t, range(64) r(p)),
 di AS (SELECT DISTINCT a.vec_id, y + dy AS y, x + dx AS x FROM px1 a, range(-1, 2) u(dy), range(-1, 2) v(dx) WHERE on_ AND y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7),
 rc AS (SELECT vec_id, y * 8 + x AS src, y, x FROM di UNION SELECT r.vec_id, r.src, d.y, d.x FROM rc r JOIN di d ON d.vec_id = r.vec_id AND abs(d.y - r.y) <= 1 AND abs(d.x - r.x) <= 1),
 oc AS (SELECT t.vec_id, coalesce(n, 0) / 64.0::DOUBLE AS occupancy FROM t LEFT JOIN (SELECT vec_id, count(*) AS n FROM (SELECT vec_id, src FROM rc GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY 1) k USING (vec_id))"""


@query("WITH RECURSIVE " + TILES + ", " + MASK + " SELECT pr.vec_id, round(a.occupancy, 6) AS occupancy, round(abs(a.occupancy - b.occupancy), 6) AS change FROM pr JOIN oc a ON a.vec_id = pr.vec_id JOIN oc b ON b.vec_id = pr.nxt")
def F25_AG21_text_mask(spark, sf):
    """Share of text pixels: threshold by polarity, dilation, components of ten pixels or more."""
    return one(spark, sf, "text", {"occupancy": "text.a_text_occupancy", "change": "text.text_occupancy_diff"})


def _matrix(weights: np.ndarray, border: str) -> str:
    """An 8 x 8 matrix that convolves a line of eight pixels, as an SQL list by columns of rows."""
    m = np.zeros((8, 8))
    place = np.pad(np.arange(8), len(weights) // 2, border)
    for i in range(8):
        for k, w in enumerate(weights):
            m[i, place[i + k]] += w
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in m.ravel().tolist()) + "]"


_conv = lambda m, v: f"list_sum(list_transform(range(64), lambda q: {m}[8 * y + q // 8 + 1] * {m}[8 * x + q % 8 + 1] * {v}))"

SIMILAR = f"""w AS (SELECT {_matrix(im.gaussian(11, 1.5), 'symmetric')} AS m),
 sm AS (SELECT vec_id, y, x, {_conv('m', 'a[q + 1]')} AS mx, {_conv('m', 'b[q + 1]')} AS my, {_conv('m', 'a[q + 1] * a[q + 1]')} AS xx, {_conv('m', 'b[q + 1] * b[q + 1]')} AS yy, {_conv('m', 'a[q + 1] * b[q + 1]')} AS xy
  FROM (SELECT pr.vec_id, a.px AS a, b.px AS b, p // 8 AS y, p % 8 AS x, m FROM pr JOIN t a ON a.vec_id = pr.vec_id JOIN t b ON b.vec_id = pr.nxt, range(64) r(p), w)),
 si AS (SELECT vec_id, y, x, ((2 * mx * my + 6.5025) * (2 * 49 / 48.0::DOUBLE * (xy - mx * my) + 58.5225)) / ((mx * mx + my * my + 6.5025) * (49 / 48.0::DOUBLE * (xx - mx * mx) + 49 / 48.0::DOUBLE * (yy - my * my) + 58.5225)) AS s FROM sm),
 sv AS (SELECT vec_id, avg(s) FILTER (y IN (3, 4) AND x IN (3, 4)) AS ssim_mean, min(s) AS ssim_min, var_pop(s) AS ssim_variance FROM si GROUP BY 1)"""


@query("WITH " + TILES + ", " + SIMILAR + " SELECT vec_id, " + rounded(["ssim_mean", "ssim_min", "ssim_variance"]) + " FROM sv")
def F21_similarity_map(spark, sf):
    """Mean, least and variance of the structural similarity over Gaussian windows."""
    return one(spark, sf, "ssim", {k: f"ssim.{k}" for k in ("ssim_mean", "ssim_min", "ssim_variance")})


def _modes(a: np.ndarray, b: np.ndarray, c: im.Config) -> dict[str, np.ndarray]:
    """Sums of the pixels after each way of preprocessing."""
    g = im.gray_of(a)
    ways = {"gray": ("gray", 0), "blurred": ("gray", 5), "adaptive": ("adaptive", 0), "blurred_adaptive": ("adaptive", 3)}
    return {name: im.preprocess(g, *way).astype(np.float64).sum(axis=(1, 2)) for name, way in ways.items()}


_way = lambda src, name: f"SELECT vec_id, sum(CASE WHEN v > round(f) - 2 THEN 255 ELSE 0 END) AS {name} FROM (SELECT vec_id, g[p + 1] AS v, {_conv('ma', 'g[q + 1]')} AS f FROM (SELECT vec_id, p, p // 8 AS y, p % 8 AS x, g, ma FROM {src}, range(64) r(p), w)) GROUP BY 1"


@query(f"""WITH {TILES}, w AS (SELECT {_matrix(im.gaussian(11), 'edge')} AS ma, {_matrix(np.array([1, 4, 6, 4, 1]), 'reflect')} AS m5, {_matrix(np.array([1, 2, 1]), 'reflect')} AS m3),
 b5 AS (SELECT vec_id, (({_conv('m5', 'px[q + 1]')})::BIGINT + 128) // 256 AS v FROM (SELECT vec_id, px, p, p // 8 AS y, p % 8 AS x, m5 FROM t, range(64) r(p), w)),
 b3 AS (SELECT vec_id, list(v ORDER BY p) AS g FROM (SELECT vec_id, p, (({_conv('m3', 'px[q + 1]')})::BIGINT + 8) // 16 AS v FROM (SELECT vec_id, px, p, p // 8 AS y, p % 8 AS x, m3 FROM t, range(64) r(p), w)) GROUP BY 1),
 s0 AS (SELECT vec_id, list_sum(px) AS gray FROM t), s1 AS (SELECT vec_id, sum(v) AS blurred FROM b5 GROUP BY 1), s2 AS ({_way('(SELECT vec_id, px AS g FROM t)', 'adaptive')}), s3 AS ({_way('b3', 'blurred_adaptive')})
 SELECT vec_id, gray::DOUBLE AS gray, blurred::DOUBLE AS blurred, adaptive::DOUBLE AS adaptive, blurred_adaptive::DOUBLE AS blurred_adaptive FROM t JOIN s0 USING (vec_id) JOIN s1 USING (vec_id) JOIN s2 USING (vec_id) JOIN s3 USING (vec_id)""")
def F28_preprocess(spark, sf):
    """Sums of the pixels as they are, blurred, and after the adaptive threshold."""
    t = tiles(spark, sf)
    e = im.extract(t.withColumn("again", F.col("image")), ["vec_id"], "image", "again", CONFIG, {"modes": _modes})
    return e.select("vec_id", *[F.col(f"modes.{k}").alias(k) for k in ("gray", "blurred", "adaptive", "blurred_adaptive")])


@query(f"""WITH RECURSIVE {TILES}, {HIST}, {EDGES}, {MASK}, {SIMILAR},
 en AS (SELECT vec_id, -list_sum(list_transform(range(256), lambda k: len(list_filter(px, lambda x: x = k)) / 64.0::DOUBLE * log2(len(list_filter(px, lambda x: x = k)) / 64.0::DOUBLE + 1e-7))) AS entropy FROM t),
 ew AS (SELECT vec_id, avg(d) AS d FROM ed GROUP BY 1), hc AS (SELECT pr.vec_id, {_compared('a.h', 'b.h')} FROM pr JOIN gh a ON a.vec_id = pr.vec_id JOIN gh b ON b.vec_id = pr.nxt)
 SELECT pr.vec_id, round(list_avg(a.px), 6) AS brightness, round(list_aggregate(a.px, 'stddev_pop'), 6) AS contrast, round(entropy, 6) AS entropy, round(abs(x.d - y.d), 6) AS edge_change, round(abs(u.occupancy - v.occupancy), 6) AS text_change, {rounded(["ssim_mean", *MEASURES], 5)},
  round(list_avg(list_transform(range(1, 65), lambda i: abs(a.px[i] - b.px[i]))), 6) AS mad, 0::BIGINT AS n_failed
 FROM pr JOIN t a ON a.vec_id = pr.vec_id JOIN t b ON b.vec_id = pr.nxt JOIN en ON en.vec_id = pr.vec_id JOIN ew x ON x.vec_id = pr.vec_id JOIN ew y ON y.vec_id = pr.nxt JOIN oc u ON u.vec_id = pr.vec_id JOIN oc v ON v.vec_id = pr.nxt JOIN sv ON sv.vec_id = pr.vec_id JOIN hc ON hc.vec_id = pr.vec_id""")
def X1_X2_pairwise_features(spark, sf):
    """All four extractors over every pair in one pass; ``n_failed`` counts the lines of the log."""
    e = im.extract(pairs(spark, sf), ["vec_id"], "image_a", "image_b", CONFIG)
    six = {"brightness": "histogram.a_brightness", "contrast": "histogram.a_contrast", "entropy": "histogram.a_entropy", "edge_change": "edge.whole_edge_density_diff", "text_change": "text.text_occupancy_diff", "mad": "ssim.mean_absolute_difference"}
    five = {"ssim_mean": "ssim.ssim_mean", **{m: _scaled(m, f"histogram.gray_hist_dist_global_{_source(m)}") for m in MEASURES}}
    return e.select("vec_id", *[F.round(F.expr(x), k).alias(n) for k, d in ((6, six), (5, five)) for n, x in d.items()], F.size("log").cast("long").alias("n_failed"))


def _pixels(a: np.ndarray, b: np.ndarray, c: im.Config) -> dict[str, np.ndarray]:
    """Sharpness, the sum of the half-sized picture, mean absolute difference and pixels that changed by over 15."""
    x, y = im.gray_of(a), im.gray_of(b)
    apart = np.abs(x.astype(np.int64) - y)
    small = [px.resize(g, g.shape[0] // 2, g.shape[1] // 2).astype(np.float64).sum() for g in x]
    return {"sharpness": np.array([px.laplacian_variance(g) for g in x]), "small": np.array(small), "mad": apart.mean(axis=(1, 2)), "changed": (apart > 15).sum(axis=(1, 2)).astype(np.float64)}


_at = lambda y, x: f"px[{_mirror(y)} * 8 + {_mirror(x)} + 1]"


@query(f"""WITH {TILES}, pix AS (SELECT vec_id, px, p // 8 AS y, p % 8 AS x FROM t, range(64) r(p)), la AS (SELECT vec_id, var_pop({_at('y - 1', 'x')} + {_at('y + 1', 'x')} + {_at('y', 'x - 1')} + {_at('y', 'x + 1')} - 4 * px[y * 8 + x + 1]) AS sharpness FROM pix GROUP BY 1),
 sm AS (SELECT vec_id, sum(round_even((px[i] + px[i + 1] + px[i + 8] + px[i + 9]) / 4, 0)) AS small FROM (SELECT vec_id, px, 16 * (c // 4) + 2 * (c % 4) + 1 AS i FROM t, range(16) r(c)) GROUP BY 1)
 SELECT pr.vec_id, round(sharpness + 1e-6, 4) AS sharpness, small, round(list_avg(list_transform(range(1, 65), lambda i: abs(a.px[i] - b.px[i]))), 6) AS mad, len(list_filter(range(1, 65), lambda i: abs(a.px[i] - b.px[i]) > 15))::DOUBLE AS changed
 FROM pr JOIN t a ON a.vec_id = pr.vec_id JOIN t b ON b.vec_id = pr.nxt JOIN la ON la.vec_id = pr.vec_id JOIN sm ON sm.vec_id = pr.vec_id""")
def F22_F26_F27_pixels(spark, sf):
    """Sharpness, resizing and differences of pictures, as one more extractor of the registry."""
    e = im.extract(pairs(spark, sf), ["vec_id"], "image_a", "image_b", CONFIG, {"pixels": _pixels})
    return e.select("vec_id", F.round(F.col("pixels.sharpness") + 1e-6, 4).alias("sharpness"), F.col("pixels.small").alias("small"), F.round("pixels.mad", 6).alias("mad"), F.col("pixels.changed").alias("changed"))
