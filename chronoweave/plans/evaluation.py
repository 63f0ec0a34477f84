"""Evaluation by its full definitions: selections against the truth, classification reports, curves, schema unions.

Selections are those of ``keyframes``; a conversation is a group, and a chosen
frame without a true label is a false positive (FP), a true frame that was not
chosen a false negative (FN).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.operators import boundaries as bd
from chronoweave.operators import curves, schemas, trees
from chronoweave.operators import grouping as gr
from chronoweave.plans import keyframes as kf
from chronoweave.plans import lessons
from chronoweave.plans.registry import query, read

ALL = ", al AS (SELECT r.mode, f.s, f.seq, f.toks, list_contains(picked, f.seq) AS mine, role IS NOT NULL AS good, coalesce(value, 0) AS value FROM res r JOIN f ON f.s = r.s LEFT JOIN gt ON gt.s = f.s AND gt.seq = f.seq LEFT JOIN events ON event_id = f.frame)"


def judged(spark, sf, modes=kf.ALL) -> DataFrame:
    """Every frame in every mode: mine (chosen), good (true), value."""
    c = kf.candidates(spark, sf).select("session", "seq", "tokens", "frame")
    v = read(spark, sf, "events").select(F.col("event_id").alias("frame"), "value")
    t = kf.truth(spark, sf).withColumn("good", F.lit(True)).drop("role")
    picks = kf.chosen(spark, sf, modes).select("session", "mode", "selected")
    d = c.join(v, "frame", "left").join(t, ["session", "seq"], "left").join(picks, "session")
    return d.select("mode", F.col("session").alias("s"), "seq", "tokens", F.array_contains("selected", F.col("seq")).alias("mine"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("value", F.lit(0.0)).alias("value"))


@query(kf.SEARCH + ALL + " SELECT mode, s, min(seq) FILTER (mine AND NOT good) AS first_fp, min(seq) FILTER (good AND NOT mine) AS first_fn FROM al GROUP BY 1, 2")
def AG25_first_failures(spark, sf):
    """The first frame wrongly chosen and the first one missed, per session and mode."""
    fp, fn = F.col("mine") & ~F.col("good"), F.col("good") & ~F.col("mine")
    return judged(spark, sf).groupBy("mode", "s").agg(F.min(F.when(fp, F.col("seq"))).alias("first_fp"), F.min(F.when(fn, F.col("seq"))).alias("first_fn"))


@query(kf.SEARCH + ALL + " SELECT p.s, p.seq AS fp, n.seq AS fn, n.seq - p.seq AS gap, n.value > p.value AS better FROM al p JOIN al n ON p.s = n.s AND n.seq > p.seq WHERE p.mode = 'B' AND n.mode = 'B' AND p.mine AND NOT p.good AND n.good AND NOT n.mine")
def J11_missed_after_wrong(spark, sf):
    """Every frame missed later in the group of a frame wrongly chosen: how much later, and whether it was the better one."""
    d = judged(spark, sf, ("B",))
    p = d.where("mine and not good").select("s", F.col("seq").alias("fp"), F.col("value").alias("a"))
    n = d.where("good and not mine").select("s", F.col("seq").alias("fn"), F.col("value").alias("b"))
    return p.join(n, "s").where("fn > fp").select("s", "fp", "fn", (F.col("fn") - F.col("fp")).alias("gap"), (F.col("b") > F.col("a")).alias("better"))


@query(kf.SEARCH + ALL + ", w AS (SELECT *, sum(good::INT) OVER (PARTITION BY s ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM al WHERE mode = 'B') SELECT s, max(seq) FILTER (good) AS truth, sum((mine AND NOT good)::INT)::BIGINT AS wrong_before FROM w GROUP BY s, ahead HAVING bool_or(good)")
def J12_wrong_between_truths(spark, sf):
    """For every true frame, how many were wrongly chosen strictly between the true one before it and itself."""
    w = Window.partitionBy("s").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    d = judged(spark, sf, ("B",)).withColumn("ahead", F.sum(F.col("good").cast("int")).over(w))
    return d.groupBy("s", "ahead").agg(F.max(F.when(F.col("good"), F.col("seq"))).alias("truth"), F.sum((F.col("mine") & ~F.col("good")).cast("long")).alias("wrong_before")).where("truth is not null").drop("ahead")


@query(kf.SEARCH + ALL + " SELECT s, seq, coalesce(last_value(CASE WHEN mine THEN seq END IGNORE NULLS) OVER (PARTITION BY s ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS previous FROM al WHERE mode = 'B'")
def J10_previous_chosen(spark, sf):
    """The frame chosen last before each frame; index 0 where there is none."""
    w = Window.partitionBy("s").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return judged(spark, sf, ("B",)).select("s", "seq", F.coalesce(F.last(F.when(F.col("mine"), F.col("seq")), ignorenulls=True).over(w), F.lit(0)).cast("long").alias("previous"))


@query(kf.SEARCH + ALL + """, se AS (SELECT s, seq, toks FROM al WHERE mode = 'B' AND mine), sm AS (SELECT a.s, a.seq AS a, b.seq AS b, CASE WHEN len(a.toks) = 0 AND len(b.toks) = 0 THEN 1.0::DOUBLE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0 ELSE round(len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks)))::DOUBLE, 4) END AS sim FROM se a JOIN f b ON a.s = b.s),
 i AS (SELECT sm.s, avg(sim) AS intra FROM sm JOIN se ON sm.s = se.s AND sm.b = se.seq WHERE a <> b GROUP BY 1), co AS (SELECT s, avg(m) AS coverage FROM (SELECT s, b, max(CASE WHEN a = b THEN 1 ELSE sim END) AS m FROM sm GROUP BY 1, 2) GROUP BY 1),
 cm AS (SELECT s, len(list_distinct(flatten(list(toks)))) / nullif(sum(len(list_distinct(toks))), 0)::DOUBLE AS complementarity FROM se GROUP BY 1)
 SELECT co.s, round(coalesce(intra, 0) + 1e-9, 6) AS intra_similarity, round(coverage + 1e-9, 6) AS coverage, round(coalesce(complementarity, 0) + 1e-9, 6) AS complementarity FROM co JOIN cm ON co.s = cm.s LEFT JOIN i ON i.s = co.s""")
def AG28_set_statistics(spark, sf):
    """Mean similarity inside the chosen set, how close every frame is to it, and the share of its tokens that are not said twice."""
    d = judged(spark, sf, ("B",)).withColumn("t", F.array_distinct("tokens"))
    mine = d.where("mine")
    a = mine.select("s", F.col("seq").alias("a"), F.col("t").alias("ta"))
    b = d.select("s", F.col("seq").alias("b"), F.col("t").alias("tb"), F.col("mine").alias("b_mine"))
    either = F.size(F.array_union("ta", "tb"))
    sim = F.when(either == 0, 1.0).otherwise(F.round(F.size(F.array_intersect("ta", "tb")) / either, 4))
    pairs = a.join(b, "s").select("s", "a", "b", "b_mine", F.when(F.col("a") == F.col("b"), 1.0).otherwise(sim).alias("near"), sim.alias("sim"))
    best = pairs.groupBy("s", "b").agg(F.max("near").alias("m"), F.sum(F.when(F.col("b_mine") & (F.col("a") != F.col("b")), F.col("sim"))).alias("x"), F.count_if(F.col("b_mine") & (F.col("a") != F.col("b"))).alias("n"))
    per = best.groupBy("s").agg(F.avg("m").alias("coverage"), F.sum("x").alias("x"), F.sum("n").alias("n"))
    said = mine.select("s", F.explode("t").alias("tok")).groupBy("s", "tok").agg(F.count(F.lit(1)).alias("c")).groupBy("s").agg(F.count(F.lit(1)).alias("u"), F.sum("c").alias("c"))
    per = per.join(said, "s", "left")
    return per.select("s", F.round(F.coalesce(F.try_divide("x", "n"), F.lit(0.0)) + 1e-9, 6).alias("intra_similarity"), F.round(F.col("coverage") + 1e-9, 6).alias("coverage"), F.round(F.coalesce(F.try_divide("u", "c"), F.lit(0.0)) + 1e-9, 6).alias("complementarity"))


@query(kf.SEARCH + ALL + ", un2 AS (SELECT s, list_distinct(flatten(list(toks))) AS u FROM al WHERE mode = 'B' AND mine GROUP BY 1) SELECT al.s, seq, CASE WHEN len(toks) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(toks, u)) / len(list_distinct(toks))::DOUBLE, 6) END AS explained FROM al JOIN un2 ON al.s = un2.s WHERE mode = 'B'")
def F17_explained(spark, sf):
    """The share of a frame's tokens that the chosen frames of its group show; 1 for a frame without tokens."""
    d = judged(spark, sf, ("B",))
    shown = d.where("mine").select("s", F.explode("tokens").alias("tok")).distinct().withColumn("shown", F.lit(1))
    t = d.select("s", "seq", F.explode(F.array_distinct("tokens")).alias("tok")).join(shown, ["s", "tok"], "left").groupBy("s", "seq").agg(F.count("shown").alias("x"), F.count(F.lit(1)).alias("n"))
    return d.select("s", "seq").join(t, ["s", "seq"], "left").select("s", "seq", F.when(F.col("n").isNull(), 1.0).otherwise(F.round(F.col("x") / F.col("n"), 6)).alias("explained"))


REPORT = """li AS (SELECT l_discount * 10 AS score, (l_returnflag = 'R')::INT AS y FROM lineitem), th AS (SELECT unnest([0.5::DOUBLE, 0.76::DOUBLE]) AS threshold),
 c AS (SELECT threshold, y, (score >= threshold)::INT AS pred, count(*) AS n FROM li, th GROUP BY 1, 2, 3),
 k AS (SELECT threshold, label, sum(CASE WHEN y = label AND pred = label THEN n ELSE 0 END) AS tp, sum(CASE WHEN pred = label THEN n ELSE 0 END) AS said, sum(CASE WHEN y = label THEN n ELSE 0 END) AS support FROM c, (VALUES (0), (1)) l(label) GROUP BY 1, 2),
 m AS (SELECT *, coalesce(tp / nullif(said, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS r, coalesce(2 * tp / nullif(said + support, 0)::DOUBLE, 0) AS f FROM k)"""


@query("WITH " + REPORT + """, o AS (SELECT threshold, label::VARCHAR AS class, p, r, f, support FROM m UNION ALL SELECT threshold, 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM m GROUP BY 1
 UNION ALL SELECT threshold, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM m GROUP BY 1 UNION ALL SELECT threshold, 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM m GROUP BY 1)
 SELECT threshold, class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support::BIGINT AS support FROM o""")
def AG30_classification_report(spark, sf):
    """Precision, recall, F1 and support of each class, their averages and the accuracy, at two thresholds in one pass."""
    d = read(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    r = curves.report(d, "y", "score", [0.5, 0.76])
    return r.select("threshold", "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("""WITH c AS (SELECT round(l_extendedprice) AS x, sum((l_returnflag = 'R')::INT) AS p, sum((l_returnflag <> 'R')::INT) AS n FROM lineitem GROUP BY 1), a AS (SELECT sum(p) AS tp, sum(n) AS tn FROM c),
 w AS (SELECT p, n, sum(n) OVER (ORDER BY x) - n AS below, sum(p) OVER (ORDER BY x DESC) AS hp, sum(p + n) OVER (ORDER BY x DESC) AS hn FROM c)
 SELECT round(sum(p * (below + n / 2.0)) / (max(tp)::DOUBLE * max(tn)), 6) AS auc, round(sum(p * hp / hn::DOUBLE) / max(tp), 6) AS average_precision, max(tp)::BIGINT AS positives, max(tn)::BIGINT AS negatives FROM w, a""")
def AG27_curves(spark, sf):
    """Area under the ROC curve and average precision over tens of thousands of distinct scores, by bucketed prefix sums."""
    d = read(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.round("l_extendedprice").alias("score"))
    r = curves.areas(d, "y", "score")
    return r.select(F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"), "positives", "negatives")


UNION = """a AS (SELECT p_partkey AS id, p_name AS name, p_size AS size, p_retailprice AS price FROM part), b AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS price, s_nationkey AS nation FROM supplier), c AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS price, c_nationkey AS nation FROM customer)"""


def _sets(spark, sf) -> dict[str, DataFrame]:
    p, s, c = (read(spark, sf, t) for t in ("part", "supplier", "customer"))
    return {
        "part": p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")),
        "supplier": s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("price"), F.col("s_nationkey").alias("nation")),
        "customer": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("price"), F.col("c_nationkey").alias("nation")),
    }


@query("WITH " + UNION + ", u AS (SELECT id, name, price, 'part' AS source, 0 AS o FROM a UNION ALL SELECT id, name, price, 'supplier', 1 FROM b UNION ALL SELECT id, name, price, 'customer', 2 FROM c) SELECT id, name, price, source FROM u")
def U1_U5_union_of_common(spark, sf):
    """The union that a schema report asks for: the columns all tables have, in the order of the first."""
    sets = _sets(spark, sf)
    report = schemas.compatibility(sets)
    return schemas.combine(sets, report, "common")


@query("WITH " + UNION + """, u AS (SELECT id % 7 AS id, NULL::VARCHAR AS name, size AS size, 0::DOUBLE AS price, NULL::BIGINT AS nation, 'part' AS source, 0 AS o FROM a UNION ALL SELECT id % 7, NULL, NULL, 0, nation, 'supplier', 1 FROM b UNION ALL SELECT id % 7, NULL, NULL, 0, nation, 'customer', 2 FROM c),
 d AS (SELECT *, row_number() OVER (PARTITION BY id, name, size, price, nation ORDER BY o) AS r FROM u) SELECT id, name, size::BIGINT AS size, price, nation, source, row_number() OVER (ORDER BY source, id, size, nation)::BIGINT AS pair_index FROM d WHERE r = 1""")
def U2_U3_W7_deduplicated_union(spark, sf):
    """All columns, missing ones null; of rows that agree in all but their source the first source's stays; then numbered anew."""
    sets = {k: d.withColumn("id", F.col("id") % 7).withColumn("name", F.lit(None).cast("string")).withColumn("price", F.lit(0.0)) for k, d in _sets(spark, sf).items()}
    sets["part"] = sets["part"].withColumn("size", F.col("size").cast("long"))
    u = schemas.combine(sets, schemas.compatibility(sets), "all")
    d = schemas.first_of_equal(u, "source", list(sets))
    return schemas.numbered(d, ["source", "id", "size", "nation"], "pair_index").select("id", "name", "size", "price", "nation", "source", "pair_index")


@query("""WITH s AS (SELECT event_id, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'math' WHEN (SELECT max(event_type) FROM events) THEN 'slides' ELSE 'other' END AS domain, CASE user_id % 4 WHEN 0 THEN 'logistic' WHEN 1 THEN 'forest' WHEN 2 THEN 'extra' ELSE 'boosted' END AS model, value / 100 AS score FROM events),
 t AS (SELECT *, CASE WHEN domain = 'math' THEN CASE model WHEN 'logistic' THEN 0.5::DOUBLE WHEN 'extra' THEN 0.2 ELSE 0.1 END WHEN domain = 'slides' AND model = 'logistic' THEN 0.76 WHEN domain = 'slides' AND model <> 'extra' THEN 0.6 ELSE 0.5 END AS threshold FROM s)
 SELECT domain, model, threshold, count(*)::BIGINT AS n, sum((score >= threshold)::INT)::BIGINT AS positive FROM t GROUP BY 1, 2, 3""")
def M8_domain_thresholds(spark, sf):
    """Decisions at the threshold of each domain and model."""
    e = read(spark, sf, "events")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    d = e.crossJoin(F.broadcast(ends)).select(  # one row is broadcast
        F.when(F.col("event_type") == F.col("lo"), "math").when(F.col("event_type") == F.col("hi"), "slides").otherwise("other").alias("domain"),
        F.element_at(F.array(*[F.lit(m) for m in ("logistic", "forest", "extra", "boosted")]), (F.col("user_id") % 4 + 1).cast("int")).alias("model"), (F.col("value") / 100).alias("score"),
    )
    return trees.decided(d, "domain", "model", "score").groupBy("domain", "model", "threshold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("decision").cast("long")).alias("positive"))


@query()
def M6_extra_trees(spark, sf):
    """Twenty trees on four columns of all order lines: rows by label and prediction."""
    d = read(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    forest = trees.fit(d, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "y", trees=20, depth=6)
    return trees.transform(d, forest, 0.25).groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 6).alias("mean"))


@query(lessons.GROUPED + ", c AS (SELECT gr.s, group_a2 AS group_id, f.seq, tok, count(*) AS c FROM (SELECT s, seq, unnest(toks) AS tok FROM f) f JOIN gr ON gr.s = f.s AND gr.seq = f.seq GROUP BY ALL), mx AS (SELECT s, group_id, tok, max(c) AS m FROM c GROUP BY ALL) SELECT s, group_id, sum(m)::BIGINT AS slots, count(*)::BIGINT AS n_distinct FROM mx GROUP BY ALL")
def AG14_AG15_group_universe(spark, sf):
    """Slots and distinct tokens of every group of approach A2."""
    f = lessons.frames(spark, sf)
    g = gr.groups(f).select("session", "seq", F.col("group_a2").alias("group_id"))
    t = f.select("session", "seq", F.explode("tokens").alias("tok")).groupBy("session", "seq", "tok").agg(F.count(F.lit(1)).alias("c")).join(g, ["session", "seq"])
    m = t.groupBy(F.col("session").alias("s"), "group_id", "tok").agg(F.max("c").alias("m"))
    return m.groupBy("s", "group_id").agg(F.sum("m").alias("slots"), F.count(F.lit(1)).alias("n_distinct"))


@query(lessons.FINAL + " SELECT s, seq, place::BIGINT AS place, editor::BIGINT AS editor, recent::BIGINT AS recent, coalesce(editor <= 1 AND recent >= 2, false) AS reset FROM sc")
def W4_canvas_resets(spark, sf):
    """A canvas is cleared where one line at most is left of two or more in the three frames before (four are asked of editors)."""
    f = gr.signals(lessons.frames(spark, sf)).select("session", "seq", "place", F.col("editor").cast("long").alias("editor"), F.col("recent").cast("long").alias("recent"))
    return bd.resets(f, "session", "place", "editor", high=2).select(F.col("session").alias("s"), "seq", F.col("place").cast("long").alias("place"), "editor", "recent", "reset")


@query(lessons.GROUPED + " SELECT s, seq, group_a2 AS group_id, first_value(seq) OVER w AS anchor, round((row_number() OVER w - 1) / (count(*) OVER (PARTITION BY s, group_a2))::DOUBLE, 6) AS position, (max(seq) OVER (PARTITION BY s, group_a2) - min(seq) OVER (PARTITION BY s, group_a2))::BIGINT AS duration FROM gr WINDOW w AS (PARTITION BY s, group_a2 ORDER BY seq)")
def W11_group_anchor(spark, sf):
    """The first frame of each frame's group, its place in the group and the group's duration."""
    w = Window.partitionBy("session", "group_a2")
    g = gr.groups(lessons.frames(spark, sf))
    return g.select(F.col("session").alias("s"), "seq", F.col("group_a2").alias("group_id"), F.min("seq").over(w).alias("anchor"), F.round((F.row_number().over(w.orderBy("seq")) - 1) / F.count(F.lit(1)).over(w), 6).alias("position"), (F.max("seq").over(w) - F.min("seq").over(w)).cast("long").alias("duration"))


@query(lessons.FINAL + " SELECT s, seq, concat_ws(',', CASE WHEN a1 <> a2 THEN 'A1!=A2' END, CASE WHEN a2 <> b2 THEN 'A2!=B2' END, CASE WHEN a1 <> b2 THEN 'A1!=B2' END) AS filters, d_ssim < 0.025 AS gated, ocr_valid AND ocr_loss IS NOT NULL AS ocr_valid, layout_valid, d_vit IS NOT NULL AS vit_valid FROM fin WHERE seq_b IS NOT NULL")
def PF3_PF4_PF9_predicates(spark, sf):
    """The gate of the picture, the validity of every signal, and which ways of grouping differ."""
    f = gr.splits(lessons.frames(spark, sf)).where("paired")
    apart = lambda a, b: F.when(F.col(a.lower()) != F.col(b.lower()), f"{a}!={b}")
    return f.select(
        F.col("session").alias("s"), "seq", F.concat_ws(",", apart("A1", "A2"), apart("A2", "B2"), apart("A1", "B2")).alias("filters"), (F.col("d_ssim") < 0.025).alias("gated"),
        (F.col("ocr_valid") & F.col("ocr_loss").isNotNull()).alias("ocr_valid"), "layout_valid", F.col("d_vit").isNotNull().alias("vit_valid"),
    )


@query(r"""WITH b AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(coalesce(html, ''), '<[^>]*>|\n'), lambda x: trim(x) <> '')) AS t FROM pages), c AS (SELECT page_id, replace(t, ' ', '') AS t FROM b),
 n AS (SELECT page_id, t, length(t) AS n, length(t) - length(regexp_replace(t, '[\p{Sm}\x{0370}-\x{03FF}]', '', 'g')) AS m, length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) - (length(t) - length(regexp_replace(t, '\p{Greek}', '', 'g'))) AS l, length(t) - length(regexp_replace(t, '[\p{Nd}²³¹⁰⁴-⁹₀-₉]', '', 'g')) AS d FROM c)
 SELECT page_id, CASE WHEN t <> '' AND (contains(t, '=') OR d + m > l OR (m > 0 AND l < 5) OR (n <= 6 AND d > 0 AND l <= 2)) THEN 'formula' ELSE 'text' END AS kind, count(*)::BIGINT AS n, sum(n)::BIGINT AS chars FROM n GROUP BY 1, 2""")
def F18_block_kinds(spark, sf):
    """How many blocks of text between the tags of each page are formulas and how many are text."""
    b = read(spark, sf, "pages").select("page_id", F.explode(F.filter(F.split(F.coalesce("html", F.lit("")), r"<[^>]*>|\n"), lambda t: F.trim(t) != "")).alias("t"))
    return b.groupBy("page_id", tx.block_type(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.replace("t", F.lit(" "), F.lit("")))).alias("chars"))


@query("WITH " + lessons.CHAIN + ", g AS (SELECT s, count(*) FILTER (quality IS NOT NULL) AS labelled, count(*) AS n FROM f LEFT JOIN labels ON doc_id = frame GROUP BY 1) SELECT s, n::BIGINT AS n_frames, labelled::BIGINT AS labelled, labelled > 0 AS has_runs, row_number() OVER (ORDER BY labelled > 0 DESC, s DESC)::BIGINT AS place FROM g")
def SC11_listed_sessions(spark, sf):
    """Sessions in the order of the list: those with labels first, then by name downwards."""
    f = lessons.frames(spark, sf).select("session", "frame")
    y = read(spark, sf, "labels").where("quality is not null").select(F.col("doc_id").alias("frame"), F.lit(1).alias("y"))
    g = f.join(y, "frame", "left").groupBy(F.col("session").alias("s")).agg(F.count(F.lit(1)).alias("n_frames"), F.count("y").alias("labelled"))
    return schemas.numbered(g.withColumn("has_runs", F.col("labelled") > 0).withColumn("__o", ~F.col("has_runs")).withColumn("__n", -F.col("s")), ["__o", "__n"], "place").drop("__o", "__n")


