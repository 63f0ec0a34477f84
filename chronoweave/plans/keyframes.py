"""Selection of key frames in all modes, and its evaluation.

Frames are those of the lessons; here a conversation is one group (its turns
are few).  A frame's quality is the value of event ``8 * conv_id + turn`` in
hundredths between 0.2 and 1 (1 where there is none).  The truth is label 1 of
that number; its role is final where it is toxic, else state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import raster
from chronoweave.functions import text as tx
from chronoweave.functions import vectors as vec
from chronoweave.operators import grouping as gr
from chronoweave.operators import selection as sl
from chronoweave.operators.layout import cells
from chronoweave.plans import lessons
from chronoweave.plans.registry import query, read

ALL = tuple(sl.MODES)


def candidates(spark, sf) -> DataFrame:
    f = lessons.frames(spark, sf)
    q = read(spark, sf, "events").select(F.col("event_id").alias("frame"), F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.col("value") / 100)).alias("quality"))
    f = f.join(q, "frame", "left").withColumn("quality", F.coalesce("quality", F.lit(1.0))).withColumn("group_id", F.lit(1).cast("long"))
    f = f.withColumn("cells", F.array_distinct(F.flatten(F.transform(raster.whole(F.col("boxes")), lambda b: cells(b)))))
    w = Window.partitionBy("session").orderBy("seq")
    f = f.withColumn("loss", tx.loss(F.col("tokens"), F.lead("tokens").over(w))).withColumn("d_ssim", vec.tile_ssim_distance(F.col("tile"), F.lead("tile").over(w)))
    return f.withColumn("event", sl.events("session", "group_id", "seq", "loss", "d_ssim"))


def chosen(spark, sf, modes=ALL) -> DataFrame:
    c = candidates(spark, sf)
    return sl.select(c, "session", "group_id", "seq", "tokens", modes, cells="cells", quality="quality", vector="embedding", event="event").withColumnRenamed("s", "session")


def truth(spark, sf) -> DataFrame:
    y = read(spark, sf, "labels").where("quality = 1").groupBy(F.col("doc_id").alias("frame")).agg(F.max("toxic").alias("toxic"))
    f = read(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), (8 * F.col("conv_id") + F.col("turn")).alias("frame"))
    return f.join(y, "frame").select("session", "seq", F.when(F.col("toxic") == 1, "final").otherwise("state").alias("role"))


# Every round of the search takes the best candidate of each conversation and mode; the sets already covered travel as lists.
SEARCH = "WITH RECURSIVE " + lessons.CHAIN + """,
 mo AS (SELECT unnest(['A', 'B', 'C', 'D', 'E1', 'E2', 'F']) AS mode),
 sl AS (SELECT s, seq, list(tok || '#' || k) AS slots FROM (SELECT s, seq, tok, row_number() OVER (PARTITION BY s, seq, tok) AS k FROM (SELECT s, seq, unnest(toks) AS tok FROM f)) GROUP BY 1, 2),
 ce AS (SELECT s, seq, list(DISTINCT gx * 16 + gy) AS cells FROM (SELECT s, seq, unnest(range(floor(x1 * 16)::BIGINT, least(15, floor(x2 * 16))::BIGINT + 1)) AS gx, y1, y2 FROM bx), range(16) r(gy) WHERE gy BETWEEN least(15, floor(least(1, y1) * 16)) AND least(15, floor(least(1, y2) * 16)) GROUP BY 1, 2),
 fr AS (SELECT sc.s, sc.seq, sc.place, coalesce(slots, []) AS slots, coalesce(cells, []) AS cells, coalesce(greatest(0.2::DOUBLE, least(1.0, value / 100)), 1.0) AS q, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u,
  CASE WHEN seq_b IS NOT NULL AND na > 0 AND round(1 - round(tt / na::DOUBLE, 4), 4) >= 0.3 AND d_ssim >= 0.025 THEN round(1 - round(tt / na::DOUBLE, 4), 4) ELSE 0 END AS event
  FROM sc LEFT JOIN sl ON sc.s = sl.s AND sc.seq = sl.seq LEFT JOIN ce ON sc.s = ce.s AND sc.seq = ce.seq LEFT JOIN events ON event_id = frame),
 un AS (SELECT s, count(*) AS n, list_distinct(flatten(list(slots))) AS slots, len(list_distinct(flatten(list(cells)))) AS n_cells FROM fr GROUP BY 1),
 pa AS (SELECT a.s, a.seq, list({'seq': b.seq, 'cos': CASE WHEN a.u IS NULL OR b.u IS NULL THEN NULL ELSE list_inner_product(a.u, b.u) END, 'sim': CASE WHEN a.u IS NULL OR b.u IS NULL THEN (a.seq = b.seq)::INT::DOUBLE ELSE list_inner_product(a.u, b.u) END} ORDER BY b.seq) AS p FROM fr a JOIN fr b ON a.s = b.s GROUP BY 1, 2),
 ca AS (SELECT mode, fr.s, fr.seq, CASE mode WHEN 'A' THEN list_filter(fr.slots, lambda x: ends_with(x, '#1')) ELSE fr.slots END AS slots, CASE WHEN mode IN ('C', 'D', 'E1', 'E2') THEN cells ELSE [] END AS cells, CASE WHEN mode IN ('D', 'E1', 'E2') THEN q ELSE 1.0::DOUBLE END AS q, CASE mode WHEN 'E2' THEN event ELSE 0 END AS event, p,
  greatest(1, CASE mode WHEN 'A' THEN len(list_filter(un.slots, lambda x: ends_with(x, '#1'))) ELSE len(un.slots) END) AS total, CASE WHEN mode IN ('C', 'D', 'E1', 'E2') THEN n_cells ELSE 0 END AS places, CASE WHEN mode IN ('C', 'D', 'E1', 'E2') AND n_cells > 0 THEN 0.15::DOUBLE ELSE 0 END AS w, n
  FROM mo, fr JOIN un ON fr.s = un.s JOIN pa ON fr.s = pa.s AND fr.seq = pa.seq),
 st AS (SELECT DISTINCT mode, s, 0 AS step, []::BIGINT[] AS picked, []::VARCHAR[] AS have, []::BIGINT[] AS seen, list_transform(p, lambda x: 0.0::DOUBLE) AS near, total, places, w FROM ca
  UNION ALL SELECT mode, s, step + 1, list_append(picked, best.seq), list_distinct(list_concat(have, best.slots)), list_distinct(list_concat(seen, best.cells)), list_transform(range(1, len(near) + 1), lambda i: CASE WHEN step = 0 THEN best.p[i].sim ELSE greatest(near[i], best.p[i].sim) END), total, places, w FROM (
   SELECT mode, s, step, picked, have, seen, near, total, places, w, arg_max({'seq': seq, 'slots': slots, 'cells': cells, 'p': p}, (round(CASE mode WHEN 'F' THEN list_sum(list_transform(range(1, len(near) + 1), lambda i: greatest(0, p[i].sim - near[i]))) / n ELSE gain * q * (1 + 0.2 * far + 0.2 * event) END, 9), round(gain, 9), q, -seq)) AS best FROM (
    SELECT st.*, c.seq, c.slots, c.cells, c.q, c.event, c.p, c.n, (1 - st.w) * len(list_filter(c.slots, lambda x: NOT list_contains(have, x))) / st.total::DOUBLE + st.w * len(list_filter(c.cells, lambda x: NOT list_contains(seen, x))) / greatest(1, st.places)::DOUBLE AS gain,
     CASE WHEN st.mode IN ('E1', 'E2') AND step > 0 THEN coalesce(list_min(list_transform(list_filter(c.p, lambda x: list_contains(picked, x.seq) AND x.cos IS NOT NULL), lambda x: greatest(0, least(1, (1 - x.cos) / 2)))), 0) ELSE 0 END AS far
    FROM st JOIN ca c ON c.mode = st.mode AND c.s = st.s AND NOT list_contains(picked, c.seq) WHERE (1 - st.w) * len(have) / st.total::DOUBLE + st.w * len(seen) / greatest(1, st.places)::DOUBLE < 0.95) WHERE gain >= 0.02 GROUP BY ALL)),
 la AS (SELECT mode, s, max(step) AS step FROM st GROUP BY 1, 2),
 fb AS (SELECT mode, s, arg_max({'seq': seq, 'slots': slots, 'cells': cells}, (round((1 - w) * len(slots) / total::DOUBLE + CASE WHEN places > 0 THEN w * len(cells) / places::DOUBLE ELSE w END, 9), q, -seq)) AS best FROM ca GROUP BY 1, 2),
 en AS (SELECT st.mode, st.s, CASE WHEN st.step = 0 THEN [fb.best.seq] ELSE list_sort(picked) END AS picked, CASE WHEN st.step = 0 THEN fb.best.slots ELSE have END AS have, CASE WHEN st.step = 0 AND w > 0 THEN fb.best.cells ELSE seen END AS seen, total, places, w,
  CASE WHEN st.step = 0 THEN 'fallback_max_standalone_info' WHEN (1 - w) * len(have) / total::DOUBLE + w * len(seen) / greatest(1, places)::DOUBLE >= 0.95 THEN 'coverage_target_reached' ELSE 'raw_information_floor' END AS reason
  FROM st JOIN la ON st.mode = la.mode AND st.s = la.s AND st.step = la.step JOIN fb ON st.mode = fb.mode AND st.s = fb.s),
 res AS (SELECT en.mode, en.s, picked, n, reason, len(have) / total::DOUBLE AS lex, CASE WHEN places > 0 THEN len(seen) / places::DOUBLE ELSE 1.0 END AS spa, w FROM en JOIN un ON en.s = un.s),
 gt AS (SELECT s, seq, CASE WHEN max(toxic) = 1 THEN 'final' ELSE 'state' END AS role FROM f JOIN labels ON doc_id = frame WHERE quality = 1 GROUP BY 1, 2)"""


@query(SEARCH + " SELECT mode, s, array_to_string(picked, ',') AS selected, n::BIGINT AS n_in, len(picked)::BIGINT AS n_selected, round((1 - w) * lex + w * spa, 4) AS coverage, round(lex, 4) AS lexical_coverage, round(spa, 4) AS spatial_coverage, round(len(picked) / n::DOUBLE, 4) AS compression, reason FROM res")
def G1_modes(spark, sf):
    """The selection of every conversation in every mode."""
    return chosen(spark, sf).select("mode", F.col("session").alias("s"), F.array_join(F.col("selected").cast("array<string>"), ",").alias("selected"), "n_in", "n_selected", "coverage", "lexical_coverage", "spatial_coverage", "compression", "reason")


@query(SEARCH + " SELECT mode, sum(n)::BIGINT AS n_in, sum(len(picked))::BIGINT AS n_selected, round(100 * (1 - sum(len(picked)) / sum(n)::DOUBLE), 4) AS compression_pct, round(avg(round((1 - w) * lex + w * spa, 4)) + 1e-9, 4) AS mean_coverage, sum((reason = 'coverage_target_reached')::INT)::BIGINT AS reached FROM res GROUP BY 1")
def G3_AG7_mode_comparison(spark, sf):
    """Frames in and selected, compression and mean coverage of each mode over all groups."""
    return chosen(spark, sf).groupBy("mode").agg(
        F.sum("n_in").alias("n_in"), F.sum("n_selected").alias("n_selected"), F.round(100 * (1 - F.sum("n_selected") / F.sum("n_in")), 4).alias("compression_pct"), F.round(F.avg("coverage") + 1e-9, 4).alias("mean_coverage"),
        F.count_if(F.col("reason") == sl.REACHED).alias("reached"),
    )


@query(SEARCH + """, ex AS (SELECT DISTINCT mode, s, unnest(picked) AS seq FROM res), h AS (SELECT mode, count(*) AS k, count(role) AS tp, count(*) FILTER (role = 'final') AS tf, count(*) FILTER (role = 'state') AS ts FROM ex LEFT JOIN gt USING (s, seq) GROUP BY 1),
 g2 AS (SELECT count(*) AS n, count(*) FILTER (role = 'final') AS nf, count(*) FILTER (role = 'state') AS ns FROM gt)
 SELECT mode, tp::BIGINT AS tp, (k - tp)::BIGINT AS fp, (n - tp)::BIGINT AS fn, round(coalesce(tp / nullif(k, 0)::DOUBLE, 0), 4) AS precision, round(coalesce(tp / nullif(n, 0)::DOUBLE, 0), 4) AS recall, round(coalesce(2 * tp / nullif(k + n, 0)::DOUBLE, 0), 4) AS f1,
  round(coalesce(tf / nullif(nf, 0)::DOUBLE, 0), 4) AS final_recall, round(coalesce(ts / nullif(ns, 0)::DOUBLE, 0), 4) AS state_recall, n::BIGINT AS n_truth, nf::BIGINT AS n_final, ns::BIGINT AS n_state, k::BIGINT AS n_selected FROM h, g2""")
def G7_AG3_modes_against_truth(spark, sf):
    """Precision, recall, F1 and the recall of each role for every mode."""
    picked = chosen(spark, sf).select("session", "mode", F.explode("selected").alias("seq"))
    return sl.evaluate(picked, truth(spark, sf))


@query(SEARCH + """, ex AS (SELECT s, unnest(picked) AS seq, true AS mine FROM res WHERE mode = 'B') SELECT coalesce(gt.s, ex.s) AS s, coalesce(gt.seq, ex.seq) AS seq, coalesce(role, '') AS role,
 CASE WHEN role IS NULL THEN 'Selected due to residual information gain or quality bonus unneeded by human' WHEN mine THEN 'TP' WHEN reason = 'coverage_target_reached' THEN 'Pruned: Algorithm terminated early upon hitting target pedagogical coverage (tau_cov)'
 WHEN reason = 'raw_information_floor' THEN 'Pruned: Frame unweighted marginal information gain fell below floor (epsilon_info)' ELSE 'Excluded by algorithm' END AS diagnosis
 FROM gt FULL JOIN ex ON gt.s = ex.s AND gt.seq = ex.seq LEFT JOIN (SELECT s, reason FROM res WHERE mode = 'B') r ON r.s = gt.s""")
def F34_selection_diagnosis(spark, sf):
    """Why a true frame was missed, or a frame chosen that nobody asked for (mode B)."""
    c = chosen(spark, sf, ("B",))
    mine = c.select("session", F.explode("selected").alias("seq"), F.lit(True).alias("mine"))
    d = truth(spark, sf).join(mine, ["session", "seq"], "full").join(c.select("session", "reason"), "session", "left")
    #: The diagnoses.
    said = (
        F.when(F.col("role").isNull(), "Selected due to residual information gain or quality bonus unneeded by human").when(F.col("mine"), "TP")
        .when(F.col("reason") == sl.REACHED, "Pruned: Algorithm terminated early upon hitting target pedagogical coverage (tau_cov)")
        .when(F.col("reason") == sl.FLOOR, "Pruned: Frame unweighted marginal information gain fell below floor (epsilon_info)").otherwise("Excluded by algorithm")
    )
    return d.select(F.col("session").alias("s"), "seq", F.coalesce("role", F.lit("")).alias("role"), said.alias("diagnosis"))


@query(SEARCH + " SELECT s, seq, round(event, 4) AS pre, round(coalesce(lag(event) OVER (PARTITION BY s ORDER BY seq), 0), 4) AS post FROM fr")
def J4_event_evidence(spark, sf):
    """The loss of the transition after a frame (pre) and of the one before it (post), where it counts as an event."""
    c = candidates(spark, sf)
    return c.select(F.col("session").alias("s"), "seq", F.round("event", 4).alias("pre"), F.round(sl.events("session", "group_id", "seq", "loss", "d_ssim", "post"), 4).alias("post"))


@query()
def G2_all_groups(spark, sf):
    """Grouping and selection in one chain: the groups of approach A2, each selected in every mode, with the trail of its choices."""
    c = candidates(spark, sf).drop("group_id", "event")
    g = gr.groups(lessons.frames(spark, sf)).select("session", "seq", F.col("group_a2").alias("group_id"))
    c = c.join(g, ["session", "seq"]).withColumn("event", sl.events("session", "group_id", "seq", "loss", "d_ssim"))
    return sl.select(c, "session", "group_id", "seq", "tokens", ALL, cells="cells", quality="quality", vector="embedding", event="event")
