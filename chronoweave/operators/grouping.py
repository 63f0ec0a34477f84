"""Three ways to group the frames of a session, with all their vetoes.

A frame has tokens, boxes, a gray tile and an embedding (any may be null).  A1
is a weighted mean of symmetric distances.  A2 measures what is lost, takes
signals that are not valid out of the mean, and passes its splits through the
vetoes: gate of the picture, bridge over pop-ups, rule of the session's class.
B2 is A2 with the distance of embeddings.

Sessions are the unit of parallelism: one window per session holds the frames
in order.  Boxes, tiles and embeddings leave the plan right after the
transition's signals are made.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import raster
from chronoweave.functions import text as tx
from chronoweave.functions import vectors as vec
from chronoweave.operators import boundaries as bd
from chronoweave.operators import sequences as sq


@dataclass(frozen=True)
class Settings:
    """Weights, thresholds and vetoes; the defaults are fixed values."""

    symmetric: Mapping[str, float] = field(default_factory=lambda: {"ssim": 0.4, "ocr": 0.4, "layout": 0.2})
    directional: Mapping[str, float] = field(default_factory=lambda: {"ssim": 0.4, "ocr": 0.4, "layout": 0.2})
    multimodal: Mapping[str, float] = field(default_factory=lambda: {"ssim": 1.0, "ocr": 1.0, "layout": 1.0, "vit": 0.5})
    threshold: float = 0.35
    min_tokens: int = 3
    gate: float = 0.025
    boilerplate: float | None = 0.7
    bridge: bool = True
    more: int = 8
    overlap: float = 0.5
    contained: float = 0.7
    gap: int = 6


def half_up(x: Column) -> Column:
    """4 decimals, half up whatever the last bit of a double says."""
    return F.round(x + 1e-9, 4)


def weighted(signals: Mapping[str, tuple[float, Column, Column]]) -> Column:
    """Mean of the valid signals {name: (weight, value, valid)}, 4 decimals."""
    num = sum((F.when(ok, w * v).otherwise(0.0) for w, v, ok in signals.values()), F.lit(0.0))
    den = sum((F.when(ok, F.lit(float(w))).otherwise(0.0) for w, _, ok in signals.values()), F.lit(0.0))
    return half_up(num / F.greatest(den, F.lit(1e-9)))


def signals(frames: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row a frame with the signals of the transition to the next one (null at a session's end).

    ``frames``: session, seq, tokens array<string>, boxes array<array<double>>,
    tile array<double>, embedding array<float>.  Equal places of a session are
    ordered arbitrarily.
    """
    none = F.array().cast("array<string>")
    f = frames.select("session", "seq", F.coalesce("tokens", none).alias("tokens"), "boxes", "tile", "embedding")
    if s.boilerplate is None:
        f = f.withColumn("bp", none)
    else:
        bp = sq.boilerplate(f, "session", "tokens", s.boilerplate).groupBy("session").agg(F.array_sort(F.collect_set("tok")).alias("bp"))
        f = f.join(bp, "session", "left").withColumn("bp", F.coalesce("bp", none))
    f = f.withColumn("own", F.array_except("tokens", "bp")).withColumn("editor", raster.inside(F.col("boxes")))
    w = Window.partitionBy("session").orderBy("seq")
    n = F.lead(F.struct("tokens", "own", "boxes", "tile", "embedding")).over(w)
    f = f.select("*", n.alias("n"), F.lag("own").over(w).alias("before"), (F.row_number().over(w) - 1).alias("place"), F.max("editor").over(w.rowsBetween(-3, -1)).alias("recent"))

    a, b, own, nxt = F.col("tokens"), F.col("n.tokens"), F.col("own"), F.col("n.own")
    filtered = F.size("bp") > 0
    raw = tx.preservation(a, b)
    kept = F.when(filtered, F.when(F.size(own) >= s.min_tokens, raster.share(F.size(F.array_intersect(own, nxt)), F.size(own)))).otherwise(raw)
    enough = F.when(filtered, F.size(own) >= s.min_tokens).otherwise((F.size(a) >= s.min_tokens) & raw.isNotNull())
    agree = F.size(F.array_intersect("before", nxt)) / F.size("before")
    pop = (F.size(own) > F.size("before") + s.more) & (F.size(own) > F.size(nxt) + s.more) & (F.size("before") > 0) & (agree >= s.overlap)
    layout = F.when(F.col("n").isNotNull(), raster.layout_change(F.col("boxes"), F.col("n.boxes")))
    f = f.withColumn("layout", layout)
    return f.select(
        "session", "seq", "place", F.col("n").isNotNull().alias("paired"), "bp", F.size(own).alias("n_own"), F.size(F.array_distinct(a)).alias("n_a"), "editor", "recent",
        vec.tile_ssim_distance(F.col("tile"), F.col("n.tile")).alias("d_ssim"), tx.jaccard_distance(a, b).alias("d_jaccard"), half_up(1 - kept).alias("ocr_loss"), enough.alias("ocr_valid"),
        F.col("layout.d_iou").alias("d_layout"), F.col("layout.preservation").alias("layout_preservation"), F.col("layout.loss").alias("layout_loss"), F.col("layout.valid").alias("layout_valid"), F.col("layout.containment").alias("containment"),
        vec.cosine_distance(F.col("embedding"), F.col("n.embedding")).alias("d_vit"), F.coalesce(pop, F.lit(False)).alias("pop"),
    )


def scores(f: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds score_a1, score_a2, score_b2 and raw_a1, raw_a2, raw_b2 (the splits before any veto)."""
    yes, c = F.lit(True), F.col
    ocr = F.coalesce(c("ocr_valid") & c("ocr_loss").isNotNull(), F.lit(False))
    layout = F.coalesce(c("layout_valid"), F.lit(False))
    m, d, t = s.symmetric, s.directional, s.multimodal
    a1 = half_up((m["ssim"] * F.coalesce("d_ssim", F.lit(0.0)) + m["ocr"] * F.coalesce("d_jaccard", F.lit(0.0)) + m["layout"] * F.coalesce("d_layout", F.lit(0.0))) / (sum(m.values()) + 1e-9))
    parts = lambda w: {"ssim": (w["ssim"], c("d_ssim"), yes), "ocr": (w["ocr"], c("ocr_loss"), ocr), "layout": (w["layout"], c("layout_loss"), layout)}
    found = {"a1": a1, "a2": weighted(parts(d)), "b2": weighted(parts(t) | {"vit": (t["vit"], c("d_vit"), c("d_vit").isNotNull())})}
    f = f.select("*", *[F.when(c("paired"), v).alias(f"score_{k}") for k, v in found.items()])
    return f.select("*", *[F.when(c("paired"), (c(f"score_{k}") >= s.threshold).cast("int")).alias(f"raw_{k}") for k in found])


def splits(frames: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The scored frames with kind of the session and the corrected splits a1, a2, b2 (0 at a session's end).

    Order of the vetoes: gate, bridge, rule of the session's class.
    """
    c = F.col
    f = scores(signals(frames, s), s).withColumn("kind", bd.session_class(c("bp")))
    f = f.withColumn("reset", F.coalesce((c("editor") <= 1) & (c("recent") >= 4), F.lit(False)))
    # Only flagged places of such sessions are gathered; a reset splits after the row before it.
    cut = bd.spaced(f.where((c("kind") == "ide") & c("reset")), "session", "place", "reset", s.gap).select("session", (c("place") - 1).alias("place"), F.lit(1).alias("cut"))
    f = f.join(cut, ["session", "place"], "left")
    quiet = F.coalesce(c("d_ssim"), F.lit(0.0)) < s.gate if s.gate > 0 else F.lit(False)
    popped = c("pop") & (c("place") > 0) if s.bridge else F.lit(False)

    def corrected(k: str) -> Column:
        split = F.when(quiet | popped, 0).otherwise(c(f"raw_{k}"))
        wiped = F.coalesce(c("containment") >= s.contained, F.lit(False))
        return F.when(~c("paired"), 0).when(c("kind") == "ide", F.coalesce(c("cut"), F.lit(0))).when((c("kind") == "blackboard") & wiped, 0).otherwise(split)

    return f.select("*", F.coalesce("raw_a1", F.lit(0)).alias("a1"), corrected("a2").alias("a2"), corrected("b2").alias("b2")).drop("cut", "reset")


def groups(frames: DataFrame, s: Settings = Settings()) -> DataFrame:
    """session, seq and the group of every frame in each of the three ways."""
    w = Window.partitionBy("session").orderBy("place")
    run = lambda k: (1 + F.coalesce(F.sum(k).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long").alias(f"group_{k}")
    return splits(frames, s).select("session", "seq", "place", "kind", *[run(k) for k in ("a1", "a2", "b2")])


def summaries(frames: DataFrame, s: Settings = Settings()) -> DataFrame:
    """approach, session, group_id, frame_count, start, end and duration of every group."""
    g = groups(frames, s)
    each = F.explode(F.array(*[F.struct(F.lit(k.upper()).alias("approach"), F.col(f"group_{k}").alias("group_id")) for k in ("a1", "a2", "b2")]))
    g = g.select("session", "seq", each.alias("g")).select("session", "seq", "g.approach", "g.group_id")
    return g.groupBy("approach", "session", "group_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.greatest(F.lit(0), F.max("seq") - F.min("seq")).cast("long").alias("duration_sec")
    )


#: What is said of a disagreement.
SAID = {
    "absorbed": "A1 Split -> A2 Merged (Asymmetric Preservation absorbed build)",
    "opened": "A1 Merged -> A2 Split",
    "triggered": "A2 Merged -> B2 Split (ViT visual deviation triggered boundary)",
    "suppressed": "A2 Split -> B2 Merged (ViT similarity suppressed boundary)",
    "alone": "A1 & A2 agreed, B2 disagreed",
}


def divergences(f: DataFrame) -> DataFrame:
    """The transitions on which the three ways disagree, with a summary of how."""
    a1, a2, b2 = F.col("a1"), F.col("a2"), F.col("b2")
    said = F.concat_ws(
        " | ", F.when(a1 > a2, SAID["absorbed"]).when(a1 < a2, SAID["opened"]), F.when(a2 < b2, SAID["triggered"]).when(a2 > b2, SAID["suppressed"]), F.when((a1 == a2) & (a1 != b2), SAID["alone"])
    )
    return f.where(F.col("paired") & ((a1 != a2) | (a2 != b2))).withColumn("diff_summary", said)
