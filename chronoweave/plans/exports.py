"""What is handed on: reports, JSON and CSV rows, listings, and the columns chosen for a model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.functions import raster
from chronoweave.functions import vectors as vec
from chronoweave.operators import anova
from chronoweave.operators import grouping as gr
from chronoweave.operators import images as im
from chronoweave.operators import sampling
from chronoweave.operators import sequences as sq
from chronoweave.plans import keyframes as kf
from chronoweave.plans import lessons, pictures
from chronoweave.plans.registry import query, read

WAYS = ("a1", "a2", "b2")


@query(lessons.GROUPED + ", rp AS (" + " UNION ALL ".join(f"SELECT '{k.upper()}' AS approach, count(seq_b) AS n_transitions, sum({k}) AS n_splits, round(avg(score_{k}) + 1e-9, 6) AS mean_score, (SELECT count(*) FROM (SELECT DISTINCT s, group_{k} FROM gr)) AS n_groups, sum((seq_b IS NOT NULL AND (a1 <> a2 OR a2 <> b2))::INT) AS divergences FROM fin" for k in WAYS) + ") SELECT approach, n_transitions::BIGINT AS n_transitions, n_splits::BIGINT AS n_splits, mean_score, n_groups::BIGINT AS n_groups, divergences::BIGINT AS divergences FROM rp")
def SK8_report_numbers(spark, sf):
    """The table of the three-way report: transitions, splits, groups and disagreements of each approach."""
    f = gr.splits(lessons.frames(spark, sf))
    apart = F.count_if(F.col("paired") & ((F.col("a1") != F.col("a2")) | (F.col("a2") != F.col("b2"))))
    sums = f.agg(
        F.count_if("paired").alias("n_transitions"), apart.alias("divergences"), F.count_distinct("session").alias("n_sessions"), *[F.sum(k).alias(f"n_{k}") for k in WAYS], *[F.avg(f"score_{k}").alias(f"m_{k}") for k in WAYS]
    )
    each = F.explode(F.array(*[F.struct(F.lit(k.upper()).alias("approach"), F.col(f"n_{k}").alias("n_splits"), F.round(F.col(f"m_{k}") + 1e-9, 6).alias("mean_score"), (F.col("n_sessions") + F.col(f"n_{k}")).alias("n_groups")) for k in WAYS])).alias("r")
    return sums.select("n_transitions", "divergences", each).select("r.approach", "n_transitions", "r.n_splits", "r.mean_score", "r.n_groups", "divergences")


@query(kf.SEARCH + """ SELECT s, to_json({'mode': mode, 'params': {'tau_coverage': 0.95::DOUBLE, 'epsilon_info': 0.02::DOUBLE}, 'summary': {'input': n::BIGINT, 'selected': len(picked)::BIGINT, 'reason': reason}, 'groups': [{'group_id': 1, 'selected': list_transform(picked, lambda x: printf('frame_%04d.jpg', x))}]})::VARCHAR AS js FROM res WHERE mode = 'B'""")
def SK10_selection_json(spark, sf):
    """One JSON document a session: parameters, summary and the frames chosen in each group."""
    c = kf.chosen(spark, sf, ("B",))
    params = F.struct(F.lit(0.95).alias("tau_coverage"), F.lit(0.02).alias("epsilon_info"))
    groups = F.array(F.struct(F.lit(1).alias("group_id"), F.transform("selected", lambda x: F.format_string("frame_%04d.jpg", x)).alias("selected")))
    whole = F.struct("mode", params.alias("params"), F.struct(F.col("n_in").alias("input"), F.col("n_selected").alias("selected"), "reason").alias("summary"), groups.alias("groups"))
    return c.select(F.col("session").alias("s"), F.to_json(whole).alias("js"))


@query(kf.SEARCH + " SELECT s, n::BIGINT AS n_in, len(picked)::BIGINT AS n_selected, reason, printf('frame_%04d.jpg', picked[1]) AS first_frame FROM res WHERE mode = 'B'")
def F36_decoded_runs(spark, sf):
    """The exported documents read back with their schema."""
    js = SK10_selection_json(spark, sf)
    d = js.select("s", F.from_json("js", "struct<mode string, summary struct<input bigint, selected bigint, reason string>, groups array<struct<group_id int, selected array<string>>>>").alias("d"))
    return d.select("s", F.col("d.summary.input").alias("n_in"), F.col("d.summary.selected").alias("n_selected"), F.col("d.summary.reason").alias("reason"), F.col("d.groups")[0]["selected"][0].alias("first_frame"))


@query()
def SK13_pair_rows(spark, sf):
    """The row of 119 numbers that a pair of pictures is exported as, by column name in order."""
    e = im.extract(pictures.pairs(spark, sf), ["vec_id"], "image_a", "image_b", pictures.CONFIG)
    flat = [F.col(f"{x}.{c}").alias({"a_": "FrameA_", "b_": "FrameB_"}.get(c[:2], "") + (c[2:] if c[:2] in ("a_", "b_") else c)) for x in im.EXTRACTORS for c in e.schema[x].dataType.names]
    return e.select("vec_id", *flat)


@query()
def SK14_block_json(spark, sf):
    """One JSON document a frame: its blocks of text in reading order."""
    b = lessons.X6_reading_order(spark, sf)
    block = F.struct("position", "block", "paragraph_id", "column_id", "line_id", "kind")
    return b.groupBy("s", "seq").agg(F.to_json(F.array_sort(F.collect_list(block))).alias("js"))


LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
RANKED = "c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, (l_returnflag = 'R')::INT) AS r FROM lineitem" for c in LINES) + ")"


@query("WITH " + RANKED + ", k AS (SELECT feature, r, row_number() OVER (ORDER BY r DESC, feature) AS top, row_number() OVER (ORDER BY r, feature) AS low FROM c) SELECT feature, round(r, 6) AS r, 'top' AS side, top::BIGINT AS place FROM k WHERE top <= 2 UNION ALL SELECT feature, round(r, 6), 'bottom', low::BIGINT FROM k WHERE low <= 2")
def T4_AG11_ranked_correlations(spark, sf):
    """The two columns that go most with the label and the two that go most against it, in order."""
    y = (F.col("l_returnflag") == "R").cast("int")
    c = read(spark, sf, "lineitem").agg(*[F.corr(x, y).alias(x) for x in LINES]).unpivot([], LINES, "feature", "r")
    place = lambda *o: F.row_number().over(Window.partitionBy().orderBy(*o)).cast("long")  # noqa: E731  a row a column
    k = c.select("feature", "r", place(F.desc("r"), "feature").alias("top"), place("r", "feature").alias("low"))
    side = lambda name, p: k.where(F.col(p) <= 2).select("feature", F.round("r", 6).alias("r"), F.lit(name).alias("side"), F.col(p).alias("place"))
    return side("top", "top").unionByName(side("bottom", "low"))


@query("""WITH l AS (SELECT l_returnflag AS y, * FROM lineitem), f AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, y, {c}::DOUBLE AS x FROM l" for c in LINES) + """), p AS (SELECT feature, y, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM f GROUP BY 1, 2),
 t AS (SELECT feature, avg(x) AS m FROM f GROUP BY 1), s AS (SELECT p.feature, sum(n * (p.m - t.m) * (p.m - t.m)) / (count(*) - 1) AS b, sum(n * v) / (sum(n) - count(*)) AS w FROM p JOIN t ON p.feature = t.feature GROUP BY 1) SELECT feature, round(b / w, 4) AS score, (row_number() OVER (ORDER BY b / w DESC) <= 3) AS chosen FROM s""")
def M2_select_k_best(spark, sf):
    """The F ratio of each column against the return flag; the best three are chosen."""
    d = read(spark, sf, "lineitem")
    best = anova.select_k_best(d, LINES, "l_returnflag", 3)
    return anova.f_scores(d, LINES, "l_returnflag").select("feature", F.round("score", 4).alias("score"), F.col("feature").isin(best).alias("chosen"))


@query("WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z)))) AS u FROM embeddings), p AS (SELECT vec_id, u, lead(u) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM v) SELECT vec_id, round(greatest(0, least(1, (1 - list_inner_product(u, n)) / 2)), 6) AS d FROM p WHERE n IS NOT NULL")
def F10_unit_distance(spark, sf):
    """The distance of unit vectors by their product alone."""
    d = read(spark, sf, "embeddings").select("label", "vec_id", vec.unit(F.col("embedding")).alias("u"))
    return sq.adjacent(d, "label", "vec_id", ["vec_id", "u"]).select(F.col("vec_id_a").alias("vec_id"), F.round(vec.unit_distance(F.col("u_a"), F.col("u_b")), 6).alias("d"))


@query("WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS h FROM embeddings) SELECT vec_id, list_sum(h) BETWEEN 1 - 1e-5 AND 1 + 1e-5 AS raw_valid, (list_sum(h) > 0) AS scaled_valid FROM t")
def F20_valid_histograms(spark, sf):
    """Whether the sizes of a vector's numbers are a histogram: as they are, and divided by their sum."""
    h = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    total = F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    d = read(spark, sf, "embeddings").select("vec_id", h.alias("h"), total.alias("t"))
    return d.select("vec_id", vec.is_histogram(F.col("h")).alias("raw_valid"), vec.is_histogram(F.transform("h", lambda x: F.try_divide(x, F.col("t")))).alias("scaled_valid"))


@query(lessons.GROUPED + ", g AS (SELECT s, group_a2 AS g, count(*) AS n, min(seq) AS start_seq FROM gr GROUP BY 1, 2) SELECT s, coalesce(arg_max(g, g) FILTER (g = 2), 1)::BIGINT AS group_id, coalesce(max(n) FILTER (g = 2), max(n) FILTER (g = 1))::BIGINT AS frame_count FROM g GROUP BY 1")
def J13_group_lookup(spark, sf):
    """The second group of every session, or the first where there is no second."""
    g = gr.summaries(lessons.frames(spark, sf)).where("approach = 'A2'")
    pick = F.when(F.col("group_id") == 2, 2).when(F.col("group_id") == 1, 1)
    best = g.groupBy(F.col("session").alias("s")).agg(F.max_by(F.struct("group_id", "frame_count"), pick).alias("g"))
    return best.select("s", "g.group_id", "g.frame_count")


@query(lessons.WITH + ", k AS (SELECT s, seq, (x2 - x1) * (y2 - y1) AS a FROM bx), m AS (SELECT s, seq, count(*) FILTER (a >= 0.02) AS large, max(a) AS best, count(*) AS n FROM k GROUP BY 1, 2) SELECT f.s, f.seq, coalesce(n, 0)::BIGINT AS n, coalesce(CASE WHEN large > 0 THEN large WHEN n > 0 THEN 1 ELSE 0 END, 0)::BIGINT AS kept, round(coalesce(best, 0), 6) AS best FROM f LEFT JOIN m ON m.s = f.s AND m.seq = f.seq")
def PF13_large_boxes(spark, sf):
    """Boxes of two hundredths of the page or more, or else the largest one."""
    f = lessons.frames(spark, sf)
    kept = raster.large(F.col("boxes"))
    return f.select(F.col("session").alias("s"), "seq", F.size("boxes").cast("long").alias("n"), F.size(kept).cast("long").alias("kept"), F.round(F.coalesce(F.array_max(F.transform("boxes", raster.area)), F.lit(0.0)), 6).alias("best"))


@query(kf.SEARCH + ", x2_ AS (SELECT s, unnest(cells) AS cell FROM fr) SELECT s, count(DISTINCT cell)::BIGINT AS n_cells, count(*)::BIGINT AS n_held FROM x2_ GROUP BY 1")
def AG16_group_cells(spark, sf):
    """The cells that the boxes of a group's frames touch."""
    c = kf.candidates(spark, sf).select(F.col("session").alias("s"), F.explode("cells").alias("cell"))
    per = c.groupBy("s", "cell").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("s").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_held"))


@query("WITH d AS (SELECT c_custkey, c_mktsegment, ('0x' || md5('42|' || c_custkey)[1:13])::BIGINT AS lot FROM customer) SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY lot) <= floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.2::DOUBLE + 0.5::DOUBLE))::INT AS test FROM d")
def M7_seeded_split(spark, sf):
    """A fifth of each segment's customers, drawn with a seed."""
    return sampling.stratified(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


@query("WITH p AS (SELECT o_orderpriority AS name, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS F, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS O, avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS P FROM orders GROUP BY 1) SELECT name, round(F, 2) AS F, round(O, 2) AS O, round(P, 2) AS P, round((F + O + P) / 3, 2) AS macro FROM p UNION ALL SELECT 'macro', round(avg(F), 2), round(avg(O), 2), round(avg(P), 2), round((avg(F) + avg(O) + avg(P)) / 3, 2) FROM p")
def AG26_macro_average(spark, sf):
    """Mean price by priority and status, with the unweighted mean of each row and of each column."""
    d = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    d = d.unionByName(d.agg(*[F.avg(c).alias(c) for c in "FOP"]).withColumn("name", F.lit("macro")))
    return d.select("name", *[F.round(c, 2).alias(c) for c in "FOP"], F.round((F.col("F") + F.col("O") + F.col("P")) / 3, 2).alias("macro"))
