"""Grouping of lessons: the chain of signals, scores, vetoes, groups and their disagreements.

Frames are turns of conversations.  The lines of a text are boxes: line k has
the height 0.04 at 0.1 + 0.05 k and grows with its length to a width of 0.8.
Vector ``8 * conv_id + turn`` of ``embeddings`` is the frame's embedding, its
64 numbers the gray tile; frames without one show what a missing signal does.
``labels`` holds the truth of the transition that starts at that number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import raster
from chronoweave.functions import text as tx
from chronoweave.operators import grouping as gr
from chronoweave.operators import reading_order as ro
from chronoweave.operators import sequences as sq
from chronoweave.plans.registry import query, read


def tile(embedding):
    """64 gray values from 64 numbers around zero."""
    return F.transform(embedding, lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((x.cast("double") + 0.5) * 255).cast("double"))))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "embedding")
    line = lambda t, k: F.array(F.lit(0.1), 0.1 + 0.05 * k, 0.1 + 0.8 * F.least(F.lit(1.0), F.length(t) / 240.0), 0.14 + 0.05 * k)
    boxes = F.transform(F.filter(F.split("text", "\n"), lambda t: t != ""), line)
    c = c.withColumn("frame", 8 * F.col("session") + F.col("seq")).join(e, "frame", "left")
    # Lists of tokens are larger than the text: they are made after the shuffle.
    return c.select("frame", "session", "seq", tx.tokenize(tx.ascii_only(F.col("text"))).alias("tokens"), boxes.alias("boxes"), "embedding", tile(F.col("embedding")).alias("tile"))

CHAIN = r"""f AS (SELECT conv_id AS s, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, 8 * conv_id + turn AS frame,
  regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '_', 'g')), '\b[a-zA-Z0-9_\-\$]+\b') AS toks, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS lines FROM conversations),
 bx AS (SELECT s, seq, 0.1::DOUBLE AS x1, 0.1::DOUBLE + 0.05::DOUBLE * k AS y1, 0.1::DOUBLE + 0.8::DOUBLE * least(1.0::DOUBLE, length(lines[k + 1]) / 240.0::DOUBLE) AS x2, 0.14::DOUBLE + 0.05::DOUBLE * k AS y2
  FROM (SELECT s, seq, lines, unnest(range(len(lines))) AS k FROM f)),
 ed AS (SELECT s, seq, count(*) FILTER (x1 >= 0.08 AND x2 <= 0.95 AND y1 >= 0.08 AND y2 <= 0.62) AS editor FROM bx GROUP BY 1, 2),
 cell AS (SELECT s, seq, floor(least(1, x1) * 256)::INT AS x0, least(255, floor(least(1, x2) * 256))::INT AS x1, floor(least(1, y1) * 256)::INT AS y0, least(255, floor(least(1, y2) * 256))::INT AS y1 FROM bx),
 ras AS (SELECT s, seq, y, bit_or((repeat('0', x0) || repeat('1', x1 - x0 + 1) || repeat('0', 255 - x1))::BIT) AS m FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM cell) GROUP BY 1, 2, 3),
 ar AS (SELECT s, seq, sum(bit_count(m))::BIGINT AS area FROM ras GROUP BY 1, 2),
 n AS (SELECT s, count(*) AS n FROM f GROUP BY 1),
 bpt AS (SELECT t.s, tok FROM (SELECT s, tok, count(*) AS df FROM (SELECT s, unnest(list_distinct(toks)) AS tok FROM f) GROUP BY 1, 2) t JOIN n ON t.s = n.s WHERE df / n.n::DOUBLE >= 0.7),
 bp AS (SELECT s, list(tok) AS bp FROM bpt GROUP BY 1),
 v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding, lambda x: least(255.0, greatest(0.0, floor((x::DOUBLE + 0.5) * 255)))) AS px FROM embeddings),
 o AS (SELECT f.*, coalesce(bp, []) AS bp, list_filter(list_distinct(toks), lambda x: NOT list_contains(coalesce(bp, []), x)) AS own, coalesce(editor, 0) AS editor, coalesce(area, 0) AS area, len(lines) AS n_boxes, e, px
  FROM f LEFT JOIN bp ON f.s = bp.s LEFT JOIN ed ON f.s = ed.s AND f.seq = ed.seq LEFT JOIN ar ON f.s = ar.s AND f.seq = ar.seq LEFT JOIN v ON f.frame = v.vec_id),
 p AS (SELECT *, lead(seq) OVER w AS seq_b, lead(toks) OVER w AS toks_b, lead(own) OVER w AS own_b, lag(own) OVER w AS own_p, lead(n_boxes) OVER w AS n_boxes_b, lead(area) OVER w AS area_b, lead(e) OVER w AS e_b, lead(px) OVER w AS px_b,
  max(editor) OVER (PARTITION BY s ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent FROM o WINDOW w AS (PARTITION BY s ORDER BY seq)),
 com AS (SELECT p.s, p.seq, sum(bit_count(a.m & b.m))::BIGINT AS both_n FROM p JOIN ras a ON p.s = a.s AND p.seq = a.seq JOIN ras b ON p.s = b.s AND p.seq_b = b.seq AND a.y = b.y GROUP BY 1, 2),
 win AS (SELECT wy * 8 + wx AS o, list(dy * 8 + dx + wy * 8 + wx + 1) AS ix FROM range(2) a(wy), range(2) b(wx), range(7) c(dy), range(7) d(dx) GROUP BY 1),
 ss AS (SELECT s, seq, avg(((2 * mx * my + 6.5025) * (2 * vxy + 58.5225)) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225))) AS sim FROM
  (SELECT s, seq, sx / 49 AS mx, sy / 49 AS my, 49 / 48.0::DOUBLE * (sxx / 49 - sx / 49 * sx / 49) AS vx, 49 / 48.0::DOUBLE * (syy / 49 - sy / 49 * sy / 49) AS vy, 49 / 48.0::DOUBLE * (sxy / 49 - sx / 49 * sy / 49) AS vxy FROM
   (SELECT s, seq, list_sum(list_transform(ix, lambda i: px[i])) AS sx, list_sum(list_transform(ix, lambda i: px_b[i])) AS sy, list_sum(list_transform(ix, lambda i: px[i] * px[i])) AS sxx, list_sum(list_transform(ix, lambda i: px_b[i] * px_b[i])) AS syy, list_sum(list_transform(ix, lambda i: px[i] * px_b[i])) AS sxy
    FROM p, win WHERE px IS NOT NULL AND px_b IS NOT NULL)) GROUP BY 1, 2),
 x AS (SELECT p.*, len(list_intersect(toks, toks_b)) AS tt, len(list_distinct(toks)) AS na, len(list_distinct(toks_b)) AS nb, coalesce(both_n, 0) AS both_n, CASE WHEN sim IS NULL THEN 1.0::DOUBLE ELSE round(greatest(0.0, least(1.0, 1 - sim)), 4) END AS d_ssim
  FROM p LEFT JOIN com ON p.s = com.s AND p.seq = com.seq LEFT JOIN ss ON p.s = ss.s AND p.seq = ss.seq),
 y AS (SELECT *, CASE WHEN na = 0 AND nb = 0 THEN 0.0::DOUBLE WHEN na = 0 OR nb = 0 THEN 1.0 ELSE round(1 - tt / (na + nb - tt)::DOUBLE, 4) END AS d_jaccard,
  CASE WHEN len(bp) > 0 THEN CASE WHEN len(own) >= 3 THEN round(len(list_intersect(own, own_b)) / len(own)::DOUBLE + 1e-9, 4) END WHEN na > 0 THEN round(tt / na::DOUBLE, 4) END AS kept,
  CASE WHEN len(bp) > 0 THEN len(own) >= 3 ELSE len(toks) >= 3 AND na > 0 END AS ocr_valid,
  CASE WHEN n_boxes = 0 AND n_boxes_b = 0 THEN 1.0::DOUBLE WHEN n_boxes = 0 OR n_boxes_b = 0 THEN 0.0 WHEN area + area_b = both_n THEN 1.0 ELSE both_n / (area + area_b - both_n)::DOUBLE END AS iou,
  CASE WHEN n_boxes = 0 AND n_boxes_b = 0 THEN 1.0::DOUBLE WHEN n_boxes = 0 OR n_boxes_b = 0 OR area = 0 THEN 0.0 ELSE round(both_n / area::DOUBLE + 1e-9, 4) END AS l_kept,
  (n_boxes = 0 AND n_boxes_b = 0) OR (n_boxes > 0 AND (n_boxes_b = 0 OR area > 0)) AS layout_valid, both_n / nullif(area_b, 0)::DOUBLE AS containment,
  CASE WHEN e IS NOT NULL AND e_b IS NOT NULL THEN round(greatest(0.0, least(1.0, (1 - list_inner_product(e, e_b) / ((sqrt(list_inner_product(e, e)) + 1e-9) * (sqrt(list_inner_product(e_b, e_b)) + 1e-9))) / 2)), 4) END AS d_vit,
  coalesce(len(own) > len(own_p) + 8 AND len(own) > len(own_b) + 8 AND len(own_p) > 0 AND len(list_intersect(own_p, own_b)) / nullif(len(own_p), 0)::DOUBLE >= 0.5, false) AS pop,
  CASE WHEN len(bp) >= 5 AND len(list_filter(bp, lambda t: regexp_matches(t, 'terminal|console|todo|run|pycharm|vscode|main|py'))) > 0 THEN 'ide' WHEN len(bp) <= 2 THEN 'blackboard' ELSE 'slides' END AS kind FROM x),
 z AS (SELECT *, round(1 - kept + 1e-9, 4) AS ocr_loss, round(1 - iou + 1e-9, 4) AS d_layout, round(1 - l_kept, 4) AS layout_loss FROM y),
 sc AS (SELECT *, CASE WHEN seq_b IS NOT NULL THEN round((0.4 * d_ssim + 0.4 * d_jaccard + 0.2 * d_layout) / (1.0::DOUBLE + 1e-9) + 1e-9, 4) END AS score_a1,
  CASE WHEN seq_b IS NOT NULL THEN round((0.4 * d_ssim + CASE WHEN ocr_valid THEN 0.4 * ocr_loss ELSE 0 END + CASE WHEN layout_valid THEN 0.2 * layout_loss ELSE 0 END) / (0.4::DOUBLE + CASE WHEN ocr_valid THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN layout_valid THEN 0.2::DOUBLE ELSE 0 END) + 1e-9, 4) END AS score_a2,
  CASE WHEN seq_b IS NOT NULL THEN round((d_ssim + CASE WHEN ocr_valid THEN ocr_loss ELSE 0 END + CASE WHEN layout_valid THEN layout_loss ELSE 0 END + coalesce(0.5 * d_vit, 0)) / (1.0::DOUBLE + CASE WHEN ocr_valid THEN 1 ELSE 0 END + CASE WHEN layout_valid THEN 1 ELSE 0 END + CASE WHEN d_vit IS NOT NULL THEN 0.5 ELSE 0 END) + 1e-9, 4) END AS score_b2 FROM z)"""

VETOES = """, fl AS (SELECT s, place, row_number() OVER (PARTITION BY s ORDER BY place) AS r FROM sc WHERE kind = 'ide' AND editor <= 1 AND recent >= 4 AND place > 0),
 sp AS (SELECT s, place, r, CASE WHEN place >= 6 THEN place ELSE 0 END AS last, place >= 6 AS taken FROM fl WHERE r = 1
  UNION ALL SELECT fl.s, fl.place, fl.r, CASE WHEN fl.place - sp.last >= 6 THEN fl.place ELSE sp.last END, fl.place - sp.last >= 6 FROM sp JOIN fl ON fl.s = sp.s AND fl.r = sp.r + 1),
 cut AS (SELECT s, place - 1 AS place FROM sp WHERE taken),
 fin AS (SELECT sc.*, coalesce((score_a1 >= 0.35)::INT, 0) AS a1, {a2} AS a2, {b2} AS b2 FROM sc LEFT JOIN cut ON sc.s = cut.s AND sc.place = cut.place)""".format(
    **{k: f"CASE WHEN seq_b IS NULL THEN 0 WHEN kind = 'ide' THEN (cut.place IS NOT NULL)::INT WHEN kind = 'blackboard' AND coalesce(containment >= 0.7, false) THEN 0 WHEN d_ssim < 0.025 OR (pop AND sc.place > 0) THEN 0 ELSE (score_{k} >= 0.35)::INT END" for k in ("a2", "b2")}
)
WITH, FINAL = "WITH " + CHAIN, "WITH RECURSIVE " + CHAIN + VETOES
GROUPED = FINAL + ", gr AS (SELECT s, seq, kind, " + ", ".join(f"(1 + coalesce(sum({k}) OVER (PARTITION BY s ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS group_{k}" for k in ("a1", "a2", "b2")) + " FROM fin)"


@query(WITH + " SELECT s, seq, len(own)::BIGINT AS n_own, len(bp)::BIGINT AS n_boilerplate, ocr_loss, ocr_valid FROM sc WHERE seq_b IS NOT NULL")
def F4_boilerplate_loss(spark, sf):
    f = gr.signals(frames(spark, sf)).where("paired")
    return f.select(F.col("session").alias("s"), "seq", F.col("n_own").cast("long").alias("n_own"), F.size("bp").cast("long").alias("n_boilerplate"), "ocr_loss", "ocr_valid")


@query(WITH + " SELECT s, seq, area, area_b, both_n, round(iou + 1e-9, 4) AS iou, d_layout, l_kept AS preservation, layout_loss AS loss, layout_valid AS valid, round(containment, 6) AS containment FROM sc WHERE seq_b IS NOT NULL")
def F5_F6_F7_layout(spark, sf):
    """Overlap, directional loss and reverse containment of unions of boxes."""
    f = sq.adjacent(frames(spark, sf), "session", "seq", ["seq", "boxes"])
    a, b = F.col("boxes_a"), F.col("boxes_b")
    f = f.withColumn("n", raster.areas(a, b)).withColumn("c", raster.layout_change(a, b))
    return f.select(
        F.col("session").alias("s"), F.col("seq_a").alias("seq"), F.col("n.a").alias("area"), F.col("n.b").alias("area_b"), F.col("n.both").alias("both_n"), "c.iou", "c.d_iou", "c.preservation", "c.loss", "c.valid", F.round("c.containment", 6).alias("containment")
    ).withColumnRenamed("d_iou", "d_layout")


@query(WITH + " SELECT s, seq, d_ssim, d_jaccard, d_layout, d_vit, score_a1, score_a2, score_b2 FROM sc WHERE seq_b IS NOT NULL")
def F13_F15_scores(spark, sf):
    """A1, A2 and B2 before any veto."""
    f = gr.scores(gr.signals(frames(spark, sf))).where("paired")
    return f.select(F.col("session").alias("s"), "seq", "d_ssim", "d_jaccard", "d_layout", "d_vit", "score_a1", "score_a2", "score_b2")


@query(FINAL + " SELECT s, seq, kind, a1, a2, b2 FROM fin WHERE seq_b IS NOT NULL")
def G5_corrected_splits(spark, sf):
    return gr.splits(frames(spark, sf)).where("paired").select(F.col("session").alias("s"), "seq", "kind", "a1", "a2", "b2")


@query(GROUPED + " SELECT s, seq, group_a1, group_a2, group_b2 FROM gr")
def G5_groups(spark, sf):
    return gr.groups(frames(spark, sf)).select(F.col("session").alias("s"), "seq", "group_a1", "group_a2", "group_b2")


@query(GROUPED + ", u AS (" + " UNION ALL ".join(f"SELECT '{k.upper()}' AS approach, s, seq, group_{k} AS group_id FROM gr" for k in ("a1", "a2", "b2")) + ") SELECT approach, s, group_id, count(*)::BIGINT AS frame_count, min(seq) AS start_seq, max(seq) AS end_seq, (max(seq) - min(seq))::BIGINT AS duration_sec FROM u GROUP BY 1, 2, 3")
def G5_group_summaries(spark, sf):
    return gr.summaries(frames(spark, sf)).withColumnRenamed("session", "s")


@query(FINAL + """ SELECT s, seq, score_a1, score_a2, score_b2, a1, a2, b2, concat_ws(' | ', CASE WHEN a1 > a2 THEN 'A1 Split -> A2 Merged (Asymmetric Preservation absorbed build)' WHEN a1 < a2 THEN 'A1 Merged -> A2 Split' END,
 CASE WHEN a2 < b2 THEN 'A2 Merged -> B2 Split (ViT visual deviation triggered boundary)' WHEN a2 > b2 THEN 'A2 Split -> B2 Merged (ViT similarity suppressed boundary)' END, CASE WHEN a1 = a2 AND a1 <> b2 THEN 'A1 & A2 agreed, B2 disagreed' END) AS diff_summary
 FROM fin WHERE seq_b IS NOT NULL AND (a1 <> a2 OR a2 <> b2)""")
def G6_three_way(spark, sf):
    d = gr.divergences(gr.splits(frames(spark, sf)))
    return d.select(F.col("session").alias("s"), "seq", "score_a1", "score_a2", "score_b2", "a1", "a2", "b2", "diff_summary")


@query(FINAL + " SELECT s, seq, (place + 1)::BIGINT AS pair_idx, score_a1, score_a2, score_b2, a1, a2, b2, quality AS label, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS note FROM fin LEFT JOIN labels ON frame = doc_id WHERE seq_b IS NOT NULL")
def J6_transition_report(spark, sf):
    """Transitions with their scores and splits, the truth's label and its note ('' where there is none)."""
    f = gr.splits(frames(spark, sf)).where("paired").withColumn("frame", 8 * F.col("session") + F.col("seq"))
    y = read(spark, sf, "labels").select(F.col("doc_id").alias("frame"), F.col("quality").alias("label"), "toxic")
    note = F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("note")
    return f.join(y, "frame", "left").select(F.col("session").alias("s"), "seq", (F.col("place") + 1).cast("long").alias("pair_idx"), "score_a1", "score_a2", "score_b2", "a1", "a2", "b2", "label", note)


@query(FINAL + ", u AS (" + " UNION ALL ".join(f"SELECT '{k.upper()}' AS approach, {k} AS pred, quality AS y FROM fin JOIN labels ON frame = doc_id WHERE seq_b IS NOT NULL" for k in ("a1", "a2", "b2")) + """),
 cm AS (SELECT approach, sum((pred = 1 AND y = 1)::INT)::BIGINT tp, sum((pred = 1 AND y = 0)::INT)::BIGINT fp, sum((pred = 0 AND y = 1)::INT)::BIGINT fn, sum((pred = 0 AND y = 0)::INT)::BIGINT tn FROM u GROUP BY 1)
 SELECT *, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0), 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 4) AS f1 FROM cm""")
def AG2_by_approach(spark, sf):
    """The confusion of each of the three ways against the labelled transitions."""
    f = gr.splits(frames(spark, sf)).where("paired").select((8 * F.col("session") + F.col("seq")).alias("doc_id"), "a1", "a2", "b2").join(read(spark, sf, "labels"), "doc_id")
    u = f.select("quality", F.explode(F.array(*[F.struct(F.lit(k.upper()).alias("approach"), F.col(k).alias("pred")) for k in ("a1", "a2", "b2")])).alias("u"))
    return sq.confusion(u.select("u.approach", "u.pred", F.col("quality").alias("y")), "y", "pred", ["approach"])


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a frame's text as blocks of a page of 1280 x 720: short lines alternate between two columns, long ones are rows."""
    f = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: t != "")).alias("block", "t"))
    n, k = F.length("t"), F.col("block")
    short, right = n < 120, (F.col("block") % 2) == 1
    x1 = F.when(short & right, 700.0).otherwise(20.0)
    return f.select(
        F.struct("session", "seq").alias("page"), "block", "t", x1.alias("x1"), (x1 + F.when(short, F.least(F.lit(560.0), 6.0 * n)).otherwise(1240.0)).alias("x2"),
        (40.0 * k + 10).alias("y1"), (40.0 * k + F.when(short, 30.0).otherwise(45.0)).alias("y2"), F.when(n % 5 == 0, 30.0).otherwise(20.0).alias("font"),
    )


@query()
def X6_reading_order(spark, sf):
    """Paragraph, band, column, line and place of every block, with its type."""
    b = blocks(spark, sf)
    found = ro.analyse(b, "page").withColumnRenamed("page", "p")
    d = found.join(b.select(F.col("page").alias("p"), "block", "t"), ["p", "block"])
    return d.select(F.col("p.session").alias("s"), F.col("p.seq").alias("seq"), "block", "paragraph_id", "band", "column_id", "line_id", "position", tx.block_type(F.col("t")).alias("kind"))
