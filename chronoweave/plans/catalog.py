"""Registered queries over the driver's tables, each with its DuckDB SQL.

Sessions are conversations (frames are turns), users of ``events``, sources of
``documents`` or labels of ``embeddings``; see README.md for the mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.functions import vectors as vec
from chronoweave.operators import boundaries as bd
from chronoweave.operators import curves
from chronoweave.operators import learning as ml
from chronoweave.operators import ranks
from chronoweave.operators import sequences as sq
from chronoweave.plans.registry import QUERIES, SQL, query, read  # noqa: F401


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("s"), F.col("turn").alias("seq"), "role", tx.tokenize(tx.ascii_only("text")).alias("toks"))


FRAMES = r"""f AS (SELECT conv_id AS s, turn AS seq, role, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '_', 'g')), '\b[a-zA-Z0-9_\-\$]+\b') AS toks FROM conversations)"""
PAIRS = FRAMES + """, p AS (SELECT s, row_number() OVER w AS pair_idx, seq AS seq_a, role AS role_a, toks AS toks_a, lead(seq) OVER w AS seq_b, lead(role) OVER w AS role_b, lead(toks) OVER w AS toks_b FROM f WINDOW w AS (PARTITION BY s ORDER BY seq)),
 q AS (SELECT *, len(list_intersect(toks_a, toks_b)) AS both_n, len(list_distinct(toks_a)) AS na, len(list_distinct(toks_b)) AS nb FROM p WHERE seq_b IS NOT NULL),
 d AS (SELECT *, CASE WHEN na = 0 AND nb = 0 THEN 0.0 WHEN na = 0 OR nb = 0 THEN 1.0 ELSE round(1 - both_n / (na + nb - both_n)::DOUBLE, 4) END AS d_jaccard, CASE WHEN na > 0 THEN round(both_n / na::DOUBLE, 4) END AS pres FROM q),
 e AS (SELECT *, round(1 - pres, 4) AS loss, (role_a <> role_b)::INT AS turned FROM d),
 g AS (SELECT *, round((0.4 * d_jaccard + CASE WHEN len(toks_a) >= 3 AND loss IS NOT NULL THEN 0.4 * loss ELSE 0 END + 0.2 * turned) / greatest(0.6 + CASE WHEN len(toks_a) >= 3 AND loss IS NOT NULL THEN 0.4 ELSE 0 END, 1e-9), 4) AS score FROM e)"""
TAU = 0.9


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sq.adjacent(frames(spark, sf_dir), "s", "seq", ["seq", "role", "toks"])
    a, b = F.col("toks_a"), F.col("toks_b")
    p = p.withColumn("d_jaccard", tx.jaccard_distance(a, b)).withColumn("pres", tx.preservation(a, b)).withColumn("loss", F.round(1 - F.col("pres"), 4))
    always = F.lit(True)
    turned = (F.col("role_a") != F.col("role_b")).cast("int")
    return p.withColumn("turned", turned).withColumn("score", sq.composite({"jaccard": (0.4, F.col("d_jaccard"), always), "loss": (0.4, F.col("loss"), (F.size(a) >= 3) & F.col("loss").isNotNull()), "turn": (0.2, F.col("turned"), always)}))


@query("WITH " + FRAMES + " SELECT s, seq, len(toks)::BIGINT AS n_tokens, len(list_distinct(toks))::BIGINT AS n_distinct FROM f")
def F1_tokenize(spark, sf):
    return frames(spark, sf).select("s", "seq", F.size("toks").cast("long").alias("n_tokens"), F.size(F.array_distinct("toks")).cast("long").alias("n_distinct"))


@query("WITH " + PAIRS + " SELECT s, pair_idx::BIGINT AS pair_idx, seq_a, seq_b FROM q")
def J1_adjacent_pairs(spark, sf):
    return sq.adjacent(frames(spark, sf), "s", "seq", ["seq"]).select("s", F.col("pair_idx").cast("long").alias("pair_idx"), "seq_a", "seq_b")


@query("WITH " + PAIRS + " SELECT s, seq_a, d_jaccard, pres, loss FROM e")
def F2_F3_token_distances(spark, sf):
    return pairs(spark, sf).select("s", "seq_a", "d_jaccard", "pres", "loss")


@query("WITH " + PAIRS + " SELECT s, seq_a, len(list_intersect(toks_a, toks_b))::BIGINT AS n_both, (na + nb - both_n)::BIGINT AS n_either, (na - both_n)::BIGINT AS n_gone FROM q")
def U7_token_sets(spark, sf):
    a, b = "toks_a", "toks_b"
    return pairs(spark, sf).select("s", "seq_a", F.size(F.array_intersect(a, b)).cast("long").alias("n_both"), F.size(F.array_union(a, b)).cast("long").alias("n_either"), F.size(F.array_except(a, b)).cast("long").alias("n_gone"))


@query("WITH " + PAIRS + f" SELECT s, seq_a, score, (score >= {TAU})::INT AS split FROM g")
def F14_composite_split(spark, sf):
    return pairs(spark, sf).select("s", "seq_a", "score", (F.col("score") >= TAU).cast("int").alias("split"))


GROUPS = f""", h AS (SELECT f.s, f.seq, coalesce((g.score >= {TAU})::INT, 0) AS split FROM f LEFT JOIN g ON f.s = g.s AND f.seq = g.seq_a),
 i AS (SELECT *, coalesce(lag(split) OVER (PARTITION BY s ORDER BY seq), 0) AS before FROM h),
 k AS (SELECT s, seq, (1 + sum(before) OVER (PARTITION BY s ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS group_id FROM i)"""


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with their groups."""
    w = Window.partitionBy("s").orderBy("seq")
    f = frames(spark, sf_dir)
    d = f.withColumn("nxt", F.lead(F.struct("role", "toks")).over(w))
    a, b = F.col("toks"), F.col("nxt.toks")
    loss = tx.loss(a, b)
    yes = F.lit(True)
    score = sq.composite({"jaccard": (0.4, tx.jaccard_distance(a, b), yes), "loss": (0.4, loss, (F.size(a) >= 3) & loss.isNotNull()), "turn": (0.2, (F.col("role") != F.col("nxt.role")).cast("int"), yes)})
    d = d.withColumn("split", F.when(F.col("nxt").isNotNull() & (score >= TAU), 1).otherwise(0))
    return sq.islands(d, "s", "seq", "split")


@query("WITH " + PAIRS + GROUPS + " SELECT s, seq, group_id FROM k")
def W3_islands(spark, sf):
    return grouped(spark, sf).select("s", "seq", "group_id")


@query("WITH " + PAIRS + GROUPS + " SELECT s, group_id, count(*)::BIGINT AS frame_count, min(seq) AS start_seq, max(seq) AS end_seq, greatest(0, max(seq) - min(seq))::BIGINT AS duration_sec FROM k GROUP BY s, group_id")
def AG5_group_summary(spark, sf):
    return sq.group_summary(grouped(spark, sf), "s", "seq", "seq")


@query("WITH " + PAIRS + GROUPS + ", z AS (SELECT s, group_id, max(seq) - min(seq) AS dur FROM k GROUP BY 1, 2) SELECT s, count(*)::BIGINT AS n_groups, round(avg(dur), 4) AS mean_duration, (count(*) - 1)::BIGINT AS triggers FROM z GROUP BY s")
def AG6_group_means(spark, sf):
    z = sq.group_summary(grouped(spark, sf), "s", "seq", "seq")
    return z.groupBy("s").agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg("duration_sec"), 4).alias("mean_duration"), (F.count(F.lit(1)) - 1).alias("triggers"))


@query("WITH " + FRAMES + ", n AS (SELECT s, count(*) AS n FROM f GROUP BY s), t AS (SELECT s, tok, count(*) AS df FROM (SELECT s, unnest(list_distinct(toks)) AS tok FROM f) GROUP BY 1, 2) SELECT t.s, tok, df::BIGINT AS df FROM t JOIN n ON t.s = n.s WHERE df / n.n::DOUBLE >= 0.7")
def AG1_boilerplate(spark, sf):
    return sq.boilerplate(frames(spark, sf), "s", "toks")


@query("WITH " + FRAMES + ", c AS (SELECT s, seq, tok, count(*) AS c FROM (SELECT s, seq, unnest(toks) AS tok FROM f) GROUP BY 1, 2, 3), m AS (SELECT s, tok, max(c) AS m FROM c GROUP BY 1, 2) SELECT s, sum(m)::BIGINT AS slots, count(*)::BIGINT AS n_distinct FROM m GROUP BY s")
def AG14_AG15_universe(spark, sf):
    c = frames(spark, sf).select("s", "seq", F.explode("toks").alias("tok")).groupBy("s", "seq", "tok").agg(F.count(F.lit(1)).alias("c"))
    m = c.groupBy("s", "tok").agg(F.max("c").alias("m"))
    return m.groupBy("s").agg(F.sum("m").alias("slots"), F.count(F.lit(1)).alias("n_distinct"))


@query("WITH " + PAIRS + GROUPS + """, t AS (SELECT f.s, f.seq, f.toks, h.split, lag(toks) OVER w AS tp, lead(toks) OVER w AS tn FROM f JOIN h ON f.s = h.s AND f.seq = h.seq WINDOW w AS (PARTITION BY f.s ORDER BY f.seq))
 SELECT s, seq, CASE WHEN coalesce(len(toks) > len(tp) + 8 AND len(toks) > len(tn) + 8 AND len(tp) > 0 AND len(list_intersect(tp, tn)) / nullif(len(list_distinct(tp)), 0)::DOUBLE >= 0.5, false) THEN 0 ELSE split END AS split FROM t""")
def W2_transient_bridge(spark, sf):
    g = grouped(spark, sf).select("s", "seq", "toks", "split")
    return sq.bridge(g, "s", "seq", "toks", "split").select("s", "seq", "split")


@query("WITH " + PAIRS + f""", x AS (SELECT (score >= {TAU})::INT AS pred, turned AS y FROM g), n AS (SELECT sum((pred = 1 AND y = 1)::INT)::BIGINT tp, sum((pred = 1 AND y = 0)::INT)::BIGINT fp, sum((pred = 0 AND y = 1)::INT)::BIGINT fn, sum((pred = 0 AND y = 0)::INT)::BIGINT tn FROM x)
 SELECT *, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0), 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 4) AS f1 FROM n""")
def AG2_confusion(spark, sf):
    p = pairs(spark, sf).select((F.col("score") >= TAU).cast("int").alias("pred"), F.col("turned").alias("y"))
    return sq.confusion(p, "y", "pred")


QUALITY = """p AS (SELECT user_id, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1)"""


@query("WITH " + QUALITY + " SELECT user_id, round(p5, 6) AS p5, round(p95, 6) AS p95 FROM p")
def AG13_percentiles(spark, sf):
    p = read(spark, sf, "events").groupBy("user_id").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("p"))
    return p.select("user_id", F.round(F.col("p")[0], 6).alias("p5"), F.round(F.col("p")[1], 6).alias("p95"))


@query("WITH " + QUALITY + " SELECT event_id, round(0.2 + 0.8 * greatest(0.0, least(1.0, (value - p5) / greatest(p95 - p5, 1e-6))), 6) AS quality FROM events JOIN p USING (user_id)")
def W6_quality(spark, sf):
    return sq.normalise_quality(read(spark, sf, "events"), "user_id", "value").select("event_id", "quality")


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent_max FROM events")
def W4_recent_max(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, -1)
    return read(spark, sf, "events").select("user_id", "event_id", F.max("value").over(w).alias("recent_max"))


@query("SELECT event_id, round((coalesce(lag(value) OVER w, 0) + coalesce(lead(value) OVER w, 0)) / 2, 6) AS around FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def W10_centred_mean(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf, "events").select("event_id", F.round((F.coalesce(F.lag("value").over(w), F.lit(0.0)) + F.coalesce(F.lead("value").over(w), F.lit(0.0))) / 2, 6).alias("around"))


@query("SELECT event_id, first_value(event_id) OVER w AS anchor, round((row_number() OVER w - 1) / (count(*) OVER (PARTITION BY user_id))::DOUBLE, 6) AS position FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def W11_anchor(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return read(spark, sf, "events").select("event_id", F.first("event_id").over(w).alias("anchor"), F.round((F.row_number().over(w) - 1) / n, 6).alias("position"))


MATCH = "SELECT event_id, {fn}(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {a} AND {b}) AS match FROM events"


def _match(spark, sf, forward: bool) -> DataFrame:
    e = read(spark, sf, "events")
    kind = e.agg(F.min("event_type").alias("k"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    w = w.rowsBetween(1, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, -1)
    hit = F.when(F.col("event_type") == F.col("k"), F.col("event_id"))
    pick = F.first(hit, ignorenulls=True) if forward else F.last(hit, ignorenulls=True)
    return e.crossJoin(F.broadcast(kind)).select("event_id", pick.over(w).alias("match"))  # one row is broadcast


@query(MATCH.format(fn="first_value", a="1 FOLLOWING", b="UNBOUNDED FOLLOWING"))
def J9_next_match(spark, sf):
    return _match(spark, sf, True)


@query(MATCH.format(fn="last_value", a="UNBOUNDED PRECEDING", b="1 PRECEDING"))
def J10_previous_match(spark, sf):
    return _match(spark, sf, False)


@query("SELECT event_id, coalesce(lead(event_id) OVER w, first_value(event_id) OVER w) AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def T9_circular_next(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf, "events").select("event_id", F.coalesce(F.lead("event_id").over(w), F.first("event_id").over(w)).alias("nxt"))


@query("SELECT d.doc_id, (l.doc_id IS NOT NULL)::INT AS ground_truth FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id")
def J5_semi_join_label(spark, sf):
    good = read(spark, sf, "labels").where("quality = 1").select("doc_id").distinct().withColumn("y", F.lit(1))
    return read(spark, sf, "documents").select("doc_id").join(good, "doc_id", "left").select("doc_id", F.coalesce("y", F.lit(0)).alias("ground_truth"))


TRUTH = """t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), a AS (SELECT doc_id FROM documents WHERE n_chars > 1500), j AS (SELECT coalesce(t.doc_id, a.doc_id) AS doc_id, CASE WHEN t.doc_id IS NULL THEN 'FP' WHEN a.doc_id IS NULL THEN 'FN' ELSE 'TP' END AS kind FROM t FULL JOIN a ON t.doc_id = a.doc_id)"""


def truth(spark, sf) -> DataFrame:
    t = read(spark, sf, "labels").where("quality = 1").select("doc_id").distinct().withColumn("t", F.lit(1))
    a = read(spark, sf, "documents").where("n_chars > 1500").select("doc_id").withColumn("a", F.lit(1))
    return t.join(a, "doc_id", "full").select("doc_id", F.when(F.col("t").isNull(), "FP").when(F.col("a").isNull(), "FN").otherwise("TP").alias("kind"))


@query("WITH " + TRUTH + " SELECT doc_id, kind FROM j")
def J7_U6_selection_vs_truth(spark, sf):
    return truth(spark, sf)


@query("WITH " + TRUTH + ", n AS (SELECT d.source, sum((kind = 'TP')::INT)::BIGINT AS tp, sum((kind = 'FP')::INT)::BIGINT AS fp, sum((kind = 'FN')::INT)::BIGINT AS fn FROM j JOIN documents d ON j.doc_id = d.doc_id GROUP BY ROLLUP (d.source)) SELECT coalesce(source, 'AGGREGATED') AS source, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall FROM n")
def AG4_micro_rollup(spark, sf):
    j = truth(spark, sf).join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    n = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(k.lower())
    r = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    d = j.rollup("source").agg(n("TP"), n("FP"), n("FN"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return d.select(F.coalesce("source", F.lit("AGGREGATED")).alias("source"), "tp", "fp", "fn", r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"))


@query("SELECT quality, count(*)::BIGINT AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS ratio FROM labels GROUP BY quality")
def AG8_label_distribution(spark, sf):
    c = read(spark, sf, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row a label


@query("SELECT count(*)::BIGINT AS n_rows, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels)))::BIGINT AS duplicates, sum((quality IS NULL)::INT)::BIGINT AS null_quality, sum((toxic IS NULL)::INT)::BIGINT AS null_toxic FROM labels")
def AG9_profile(spark, sf):
    d = read(spark, sf, "labels")
    per = d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"), *[F.sum(F.when(F.isnull(c), F.col("n")).otherwise(0)).alias(f"null_{c}") for c in ("quality", "toxic")])


@query("SELECT count(l_quantity)::BIGINT AS n, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, min(l_quantity) AS lo, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS hi FROM lineitem")
def AG10_describe(spark, sf):
    d = read(spark, sf, "lineitem")
    sums = d.agg(F.count("l_quantity").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.round(F.stddev_samp("l_quantity"), 4).alias("std"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    q = ranks.one_row(ranks.quantiles(d, ["l_quantity"], [0.25, 0.5, 0.75]), ["l_quantity"])
    return sums.crossJoin(F.broadcast(q)).select("n", "mean", "std", "lo", *[F.col("l_quantity")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))], "hi")  # one row is broadcast


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, (l_returnflag = 'R')::INT), 6) AS r FROM lineitem" for c in NUMERIC))
def AG11_correlations(spark, sf):
    y = (F.col("l_returnflag") == "R").cast("int")
    one = read(spark, sf, "lineitem").agg(*[F.round(F.corr(c, y), 6).alias(c) for c in NUMERIC])
    return one.unpivot([], NUMERIC, "feature", "r")


@query("SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}, round(quantile_cont({c}, 0.99), 4) AS q99_{c}, stddev_samp({c}) = 0 AS flat_{c}" for c in NUMERIC) + " FROM lineitem")
def AG12_medians(spark, sf):
    d = read(spark, sf, "lineitem")
    q = ranks.one_row(ranks.quantiles(d, NUMERIC, [0.5, 0.99]), NUMERIC)
    flat = d.agg(*[(F.stddev_samp(c) == 0).alias(f"flat_{c}") for c in NUMERIC])
    return flat.crossJoin(F.broadcast(q)).select(*[e for c in NUMERIC for e in (F.col(c)[0].alias(f"med_{c}"), F.round(F.col(c)[1], 4).alias(f"q99_{c}"), F.col(f"flat_{c}"))])  # one row is broadcast


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS F, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS O, round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS P FROM orders GROUP BY 1")
def AG26_pivot(spark, sf):
    d = read(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return d.select("o_orderpriority", *[F.round(c, 2).alias(c) for c in "FOP"])


@query("WITH c AS (SELECT l_quantity AS x, sum((l_returnflag = 'R')::INT) AS p, sum((l_returnflag <> 'R')::INT) AS n FROM lineitem GROUP BY 1), w AS (SELECT p, n, sum(n) OVER (ORDER BY x) - n AS below FROM c) SELECT round(sum(p * (below + n / 2.0)) / (sum(p)::DOUBLE * sum(n)), 6) AS auc FROM w")
def AG27_auc(spark, sf):
    d = read(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity")
    return curves.areas(d, "y", "l_quantity").select(F.round("auc", 6).alias("auc"))


@query("SELECT p_partkey AS k, p_name AS name, 'part' AS src FROM part UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def U1_union_common(spark, sf):
    a = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.lit("part").alias("src"))
    return a.unionByName(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("src")))


@query("SELECT p_partkey AS k, p_size AS size, NULL::DOUBLE AS bal FROM part UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def U2_union_missing(spark, sf):
    a = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    return a.unionByName(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def U3_keep_first(spark, sf):
    return sq.keep_first(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")])


@query("SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id LIMIT 24 OFFSET 24")
def T6_page(spark, sf):
    return read(spark, sf, "events").select("event_id", "ts", "value").orderBy(F.desc("ts"), "event_id").offset(24).limit(24)


@query("SELECT user_id, arg_max(event_id, (round(value, 7), -event_id)) AS best FROM events GROUP BY 1")
def T2_argmax(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(F.round("value", 7), -F.col("event_id"))).alias("best"))


@query("SELECT doc_id, printf('frame_%04d.jpg', doc_id) AS filename, doc_id::INT AS sec, printf('%02d:%02d', doc_id // 60, doc_id % 60) AS stamp FROM documents")
def PF1_timestamps(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.format_string("frame_%04d.jpg", "doc_id").alias("filename"))
    sec = tx.frame_seconds(F.col("filename"), F.lit(0))
    return d.select("doc_id", "filename", sec.alias("sec"), tx.stamp(sec).alias("stamp"))


COS = """v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)"""


@query("WITH " + COS + " SELECT label, vec_id, round(greatest(0.0, least(1.0, (1 - list_inner_product(e, n) / ((sqrt(list_inner_product(e, e)) + 1e-9) * (sqrt(list_inner_product(n, n)) + 1e-9))) / 2)), 4) AS d_cosine FROM v WHERE n IS NOT NULL")
def F9_cosine_distance(spark, sf):
    p = sq.adjacent(read(spark, sf, "embeddings"), "label", "vec_id", ["vec_id", "embedding"])
    return p.select("label", F.col("vec_id_a").alias("vec_id"), vec.cosine_distance(F.col("embedding_a"), F.col("embedding_b")).alias("d_cosine"))


@query("SELECT date_trunc('hour', ts) AS w, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ST4_tumbling(spark, sf):
    w = F.window("ts", "1 hour")
    return read(spark, sf, "events").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("w"), "event_type", "n", "total")


@query("SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) % 5 = 0)::INT AS test FROM customer")
def M7_stratified_split(spark, sf):
    w = Window.partitionBy("c_mktsegment").orderBy("c_custkey")
    return read(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.row_number().over(w) % 5 == 0).cast("int").alias("test"))


@query("WITH " + PAIRS + f", x AS (SELECT s, seq_a, (d_jaccard >= {TAU})::INT AS a1, (score >= {TAU})::INT AS a2, turned AS b2 FROM g) SELECT s, seq_a, concat_ws(' | ', CASE WHEN a1 <> a2 THEN 'A1 vs A2' END, CASE WHEN a2 <> b2 THEN 'A2 vs B2' END, CASE WHEN a1 <> b2 THEN 'A1 vs B2' END) AS diff FROM x WHERE a1 <> a2 OR a2 <> b2 OR a1 <> b2")
def G6_divergence(spark, sf):
    x = pairs(spark, sf).select("s", "seq_a", (F.col("d_jaccard") >= TAU).cast("int").alias("a1"), (F.col("score") >= TAU).cast("int").alias("a2"), F.col("turned").alias("b2"))
    say = lambda a, b: F.when(F.col(a.lower()) != F.col(b.lower()), f"{a} vs {b}")
    return x.where("a1 <> a2 or a2 <> b2 or a1 <> b2").select("s", "seq_a", F.concat_ws(" | ", say("A1", "A2"), say("A2", "B2"), say("A1", "B2")).alias("diff"))


@query()
def G1_greedy_selection(spark, sf):
    from chronoweave.operators.selection import select_frames

    return select_frames(grouped(spark, sf), "s", "group_id", "seq", "toks")


# Second part: further joins, filters, sinks' projections and evaluation.


@query("SELECT v.vec_id, v.label, coalesce(e.value, 1.0) AS quality FROM embeddings v LEFT JOIN events e ON v.vec_id = e.event_id")
def J3_quality_default(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("vec_id"), "value")
    return read(spark, sf, "embeddings").select("vec_id", "label").join(e, "vec_id", "left").select("vec_id", "label", F.coalesce("value", F.lit(1.0)).alias("quality"))


@query("SELECT d.doc_id, size(e.embedding) AS dim FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id".replace("size(", "len("))
def J2_embedding_join(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("dim"))
    return read(spark, sf, "documents").select("doc_id").join(e, "doc_id", "left")


@query("SELECT a.label, a.vec_id AS a, count(*)::BIGINT AS n FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id > a.vec_id GROUP BY 1, 2")
def J11_later_in_group(spark, sf):
    """How many rows of a group come later: counted by a window, not by pairing."""
    w = Window.partitionBy("label").orderBy(F.desc("vec_id"))
    return read(spark, sf, "embeddings").select("label", F.col("vec_id").alias("a"), (F.row_number().over(w) - 1).cast("long").alias("n")).where("n > 0")


@query("WITH e AS (SELECT *, event_type = (SELECT min(event_type) FROM events) AS gt FROM events), g AS (SELECT *, sum(gt::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM e) SELECT user_id, coalesce(k, 0)::BIGINT AS stretch, sum((NOT gt)::INT)::BIGINT AS between_gt FROM g GROUP BY 1, 2")
def J12_between_truths(spark, sf):
    e = read(spark, sf, "events")
    kind = e.agg(F.min("event_type").alias("k0"))
    d = e.crossJoin(F.broadcast(kind)).withColumn("gt", (F.col("event_type") == F.col("k0")).cast("long"))  # one row is broadcast
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("stretch", F.coalesce(F.sum("gt").over(w), F.lit(0)))
    return d.groupBy("user_id", "stretch").agg(F.sum(1 - F.col("gt")).alias("between_gt"))


@query("WITH " + PAIRS + " SELECT s, seq_a, CASE WHEN d_jaccard < 0.5 THEN 0 ELSE (score >= 0.9)::INT END AS pred FROM g")
def PF3_consistency_gate(spark, sf):
    return pairs(spark, sf).select("s", "seq_a", F.when(F.col("d_jaccard") < 0.5, 0).otherwise((F.col("score") >= TAU).cast("int")).alias("pred"))


@query("WITH " + PAIRS + " SELECT s, seq_a, (len(toks_a) >= 3 AND loss IS NOT NULL) AS ocr_valid, pres IS NOT NULL AS has_loss FROM g")
def PF4_signal_validity(spark, sf):
    p = pairs(spark, sf)
    return p.select("s", "seq_a", ((F.size("toks_a") >= 3) & F.col("loss").isNotNull()).alias("ocr_valid"), F.col("pres").isNotNull().alias("has_loss"))


@query("WITH " + PAIRS + GROUPS + " SELECT s, seq, group_id FROM k WHERE group_id BETWEEN 2 AND 3")
def PF10_group_range(spark, sf):
    return grouped(spark, sf).where(F.col("group_id").between(2, 3)).select("s", "seq", "group_id")


@query("SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM part")
def PF14_sanitise(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.regexp_replace("p_name", "[^A-Za-z0-9_-]", "_").alias("safe"))


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 1 ELSE (value >= 50)::INT END AS keep FROM events")
def PF5_threshold(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf, "events").select("event_id", F.when(F.row_number().over(w) == 1, 1).otherwise((F.col("value") >= 50).cast("int")).alias("keep"))


# A supplier is a kept box in the 11,000 x 720 frame of its nation; the crop is the boxes' hull, padded by 10 and cut to the frame.
_BOX = "CAST(floor(s_acctbal + 1000) AS BIGINT) AS x, (s_suppkey * 37) % 700 AS y"


@query(f"""WITH b AS (SELECT s_nationkey, {_BOX} FROM supplier),
 c AS (SELECT s_nationkey, greatest(0, min(x) - 10) AS x1, greatest(0, min(y) - 10) AS y1, least(11000, max(x) + 60) AS x2, least(720, max(y) + 30) AS y2 FROM b GROUP BY 1)
 SELECT n_nationkey, CASE WHEN x1 IS NULL THEN 'NO_TEXT_REGION_DETECTED' ELSE 'CONTENT_DETECTED' END AS status, coalesce(x1, 0) AS x1, coalesce(y1, 0) AS y1, coalesce(x2, 0) AS x2, coalesce(y2, 0) AS y2,
 coalesce((2000 * (x2 - x1) * (y2 - y1) + 7920000) // 15840000, 0) AS retained_permille FROM nation LEFT JOIN c ON s_nationkey = n_nationkey""")
def F29_crop_box(spark, sf):
    b = read(spark, sf, "supplier").select("s_nationkey", F.floor(F.col("s_acctbal") + 1000).cast("long").alias("x"), (F.col("s_suppkey") * 37 % 700).alias("y"))
    ends = [F.greatest(F.lit(0), F.min("x") - 10).alias("x1"), F.greatest(F.lit(0), F.min("y") - 10).alias("y1"), F.least(F.lit(11000), F.max("x") + 60).alias("x2"), F.least(F.lit(720), F.max("y") + 30).alias("y2")]
    c = read(spark, sf, "nation").select("n_nationkey").join(b.groupBy("s_nationkey").agg(*ends), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    status = F.when(F.col("x1").isNull(), "NO_TEXT_REGION_DETECTED").otherwise("CONTENT_DETECTED").alias("status")
    share = F.expr("coalesce((2000 * (x2 - x1) * (y2 - y1) + 7920000) div 15840000, 0)").alias("retained_permille")
    return c.select("n_nationkey", status, *[F.coalesce(x, F.lit(0)).alias(x) for x in ("x1", "y1", "x2", "y2")], share)


@query("WITH q AS (SELECT quantile_cont(l_tax, 0.5) AS med, quantile_cont(l_tax, 0.99) AS q99 FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN q99 > 0 THEN least(coalesce(nullif(l_tax, 0), med), 10 * q99) ELSE coalesce(nullif(l_tax, 0), med) END AS tax FROM lineitem, q")
def F30_impute_clip(spark, sf):
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    q = ranks.one_row(ranks.quantiles(d, ["l_tax"], [0.5, 0.99]), ["l_tax"]).select(F.col("l_tax")[0].alias("med"), F.col("l_tax")[1].alias("q99"))
    filled = F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.col("med"))
    return d.crossJoin(F.broadcast(q)).select("l_orderkey", "l_linenumber", F.when(F.col("q99") > 0, F.least(filled, 10 * F.col("q99"))).otherwise(filled).alias("tax"))  # one row is broadcast


@query("SELECT event_id, user_id, CASE WHEN value < 0 THEN 'negative' ELSE 'above' END AS violation FROM events WHERE value < 0 OR value > 100")
def F31_violations(spark, sf):
    return read(spark, sf, "events").where("value < 0 or value > 100").select("event_id", "user_id", F.when(F.col("value") < 0, "negative").otherwise("above").alias("violation"))


@query("SELECT event_id, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS js FROM events")
def F36_json(spark, sf):
    return read(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("js"))


@query("SELECT event_id, concat_ws(',', event_id::VARCHAR, user_id::VARCHAR, event_type) AS line FROM events")
def SK3_csv_row(spark, sf):
    return read(spark, sf, "events").select("event_id", F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type").alias("line"))


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, '') AS label, coalesce(l.toxic::VARCHAR, '') AS note FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def SK5_truth_projection(spark, sf):
    e = F.lit("")
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), e).alias("label"), F.coalesce(F.col("toxic").cast("string"), e).alias("note"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'final' ELSE 'state' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, toxic DESC) AS r FROM labels WHERE quality = 1) WHERE r = 1")
def SC8_keyframe_truth(spark, sf):
    d = sq.keep_first(read(spark, sf, "labels").where("quality = 1"), ["doc_id"], [F.desc("quality"), F.desc("toxic")])
    return d.select("doc_id", F.when(F.col("toxic") == 1, "final").otherwise("state").alias("role"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS marked, coalesce(max(toxic), 0)::INT AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality = 1 GROUP BY ALL")
def SK12_marked(spark, sf):
    """The set of candidates after labels of quality 1 were marked: every document, marked or not."""
    m = read(spark, sf, "labels").where("quality = 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("marked", F.lit(True))
    return read(spark, sf, "documents").select("doc_id").join(m, "doc_id", "left").select("doc_id", F.coalesce("marked", F.lit(False)).alias("marked"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def SK12_unmarked(spark, sf):
    """What is left after every labelled document was taken out."""
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT source, count(*)::BIGINT AS frames, sum((l.toxic = 1)::INT)::BIGINT AS final, sum((l.toxic = 0)::INT)::BIGINT AS state, round(1 - sum((l.quality = 1)::INT) / count(*)::DOUBLE, 4) AS compression FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def AG31_role_counts(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("toxic") == 1).alias("final"), F.count_if(F.col("toxic") == 0).alias("state"), F.round(1 - F.count_if(F.col("quality") == 1) / F.count(F.lit(1)), 4).alias("compression"))


@query("SELECT quality AS label, toxic AS pred, count(*)::BIGINT AS n FROM labels GROUP BY GROUPING SETS ((quality, toxic), (quality), ())")
def AG30_grouping_sets(spark, sf):
    return read(spark, sf, "labels").rollup(F.col("quality").alias("label"), F.col("toxic").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 2) AS mean, quantile_cont(l_extendedprice, 0.5) AS med, round(stddev_pop(l_extendedprice), 2) AS std, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")
def AG22_category_stats(spark, sf):
    x, d = "l_extendedprice", read(spark, sf, "lineitem")
    q = ranks.quantiles(d, [x], [0.5], ["l_returnflag"]).select("l_returnflag", F.col("q")[0].alias("med"))
    s = d.groupBy("l_returnflag").agg(F.round(F.avg(x), 2).alias("mean"), F.round(F.stddev_pop(x), 2).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return s.join(q.withColumnRenamed("l_returnflag", "f"), F.col("l_returnflag").eqNullSafe(F.col("f")), "left").select("l_returnflag", "mean", "med", "std", "lo", "hi")


@query("SELECT lam, l_returnflag, sum((l_discount >= lam)::INT)::BIGINT AS kept, sum((l_discount < lam)::INT)::BIGINT AS dropped FROM lineitem, (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.08::DOUBLE)) t(lam) GROUP BY 1, 2")
def AG24_sweep(spark, sf):
    """One pass: each threshold is a pair of conditional counts, so rows are not multiplied."""
    lams = [0.02, 0.05, 0.08]
    d = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[F.struct(F.lit(v).alias("lam"), F.count_if(F.col("l_discount") >= v).alias("kept"), F.count_if(F.col("l_discount") < v).alias("dropped")).alias(f"x{i}") for i, v in enumerate(lams)])
    return d.select("l_returnflag", F.explode(F.array(*[f"x{i}" for i in range(3)])).alias("x")).select("x.lam", "l_returnflag", "x.kept", "x.dropped")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::BIGINT AS r FROM part QUALIFY r <= 5")
def W13_top_k(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return read(spark, sf, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("r")).where("r <= 5")


@query("WITH c AS (SELECT *, sum(CASE WHEN ts - prev <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM c GROUP BY user_id, k")
def ST4_sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTES")
    d = read(spark, sf, "events").withColumn("new", F.when(gap, 0).otherwise(1)).withColumn("k", F.sum("new").over(w))
    return d.groupBy("user_id", "k").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).drop("k")


@query("SELECT source, doc_id, CASE WHEN quality = 1 AND n_chars > 1500 THEN 'TP' WHEN quality = 1 THEN 'missed: ' || coalesce(lang, '?') WHEN n_chars > 1500 THEN 'extra' ELSE 'TN' END AS diagnosis FROM documents JOIN labels USING (doc_id)")
def F34_diagnosis(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(read(spark, sf, "labels"), "doc_id")
    good, long = F.col("quality") == 1, F.col("n_chars") > 1500
    return d.select("source", "doc_id", F.when(good & long, "TP").when(good, F.concat(F.lit("missed: "), F.coalesce("lang", F.lit("?")))).when(long, "extra").otherwise("TN").alias("diagnosis"))


@query("SELECT source, min_by(doc_id, doc_id) FILTER (quality = 0) AS first_fp, min_by(doc_id, doc_id) FILTER (quality = 1) AS first_fn FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def AG25_failure_harvest(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.min(F.when(F.col("quality") == 0, F.col("doc_id"))).alias("first_fp"), F.min(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("first_fn"))


@query("WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(v, v)), 4) AS norm, round(v[1] / sqrt(list_inner_product(v, v)), 4) AS first FROM e")
def F12_unit_vectors(spark, sf):
    d = read(spark, sf, "embeddings")
    return d.select("vec_id", F.round(vec.norm(F.col("embedding")), 4).alias("norm"), F.round(vec.unit(F.col("embedding"))[0], 4).alias("first"))


TILE = "t AS (SELECT vec_id, label, list_transform(embedding, lambda x: least(255.0, greatest(0.0, floor((x::DOUBLE + 0.5) * 255)))) AS px FROM embeddings)"


def tiles(spark, sf) -> DataFrame:
    px = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((x.cast("double") + 0.5) * 255).cast("double"))))
    return read(spark, sf, "embeddings").select("vec_id", "label", px.alias("px"))


@query("WITH " + TILE + " SELECT vec_id, round(list_avg(px), 4) AS mean, round(list_stddev_pop(px), 4) AS std FROM t")
def AG17_pixel_stats(spark, sf):
    total = lambda f: F.aggregate("px", F.lit(0.0), lambda s, x: s + f(x))
    n = F.size("px")
    d = tiles(spark, sf).withColumn("m", total(lambda x: x) / n)
    return d.select("vec_id", F.round("m", 4).alias("mean"), F.round(F.sqrt(F.aggregate(F.transform("px", lambda x: (x - F.col("m")) * (x - F.col("m"))), F.lit(0.0), lambda s, x: s + x) / n), 4).alias("std"))


@query("WITH " + TILE + ", p AS (SELECT vec_id, px, lead(px) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM t) SELECT vec_id, round(list_avg(list_transform(range(1, 65), lambda i: abs(px[i] - n[i]))), 4) AS mad, len(list_filter(range(1, 65), lambda i: abs(px[i] - n[i]) > 15))::BIGINT AS changed FROM p WHERE n IS NOT NULL")
def F23_AG29_pixel_change(spark, sf):
    p = sq.adjacent(tiles(spark, sf), "label", "vec_id", ["vec_id", "px"])
    diff = F.zip_with("px_a", "px_b", lambda a, b: F.abs(a - b))
    return p.select(F.col("vec_id_a").alias("vec_id"), F.round(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x) / F.size("px_a"), 4).alias("mad"), F.size(F.filter(diff, lambda x: x > 15)).cast("long").alias("changed"))


# Third part: boxes, listings, and evaluation by role.

BOXES = """b AS (SELECT doc_id, least(1.0, n_chars / 4000.0::DOUBLE) AS x2, (doc_id % 10) / 10.0::DOUBLE AS y1, (doc_id % 10) / 10.0::DOUBLE + 0.08 AS y2 FROM documents)"""


def boxes(spark, sf) -> DataFrame:
    y = (F.col("doc_id") % 10) / F.lit(10.0)
    x2 = F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0))
    return read(spark, sf, "documents").select("doc_id", "source", F.array(F.lit(0.0), y, x2, y + 0.08).alias("box"))


@query("WITH " + BOXES + " SELECT doc_id, ((least(15, floor(x2 * 16)) + 1) * (least(15, floor(least(1.0, y2) * 16)) - least(15, floor(y1 * 16)) + 1))::BIGINT AS n_cells FROM b")
def F8_cells(spark, sf):
    from chronoweave.operators.layout import cells

    return boxes(spark, sf).select("doc_id", F.size(F.array_distinct(cells(F.col("box")))).cast("long").alias("n_cells"))


@query("WITH " + BOXES + ", c AS (SELECT source, gx * 16 + gy AS cell FROM (SELECT doc_id, unnest(range(0, least(15, floor(x2 * 16))::BIGINT + 1)) AS gx, y1, y2 FROM b) JOIN (SELECT doc_id AS d2, source FROM documents) ON doc_id = d2, range(0, 16) r(gy) WHERE gy BETWEEN least(15, floor(y1 * 16)) AND least(15, floor(least(1.0, y2) * 16))) SELECT source, count(DISTINCT cell)::BIGINT AS n_cells FROM c GROUP BY 1")
def AG16_spatial_universe(spark, sf):
    from chronoweave.operators.layout import cells

    c = boxes(spark, sf).select("source", F.explode(cells(F.col("box"))).alias("cell"))
    return c.groupBy("source").agg(F.count_distinct("cell").alias("n_cells"))


@query("WITH " + BOXES + " SELECT doc_id FROM b WHERE x2 <= 0.95 AND y1 >= 0.08 AND y2 <= 0.62")
def PF12_editor_region(spark, sf):
    b = F.col("box")
    return boxes(spark, sf).where((b[2] <= 0.95) & (b[1] >= 0.08) & (b[3] <= 0.62)).select("doc_id")


@query("WITH " + BOXES + " SELECT doc_id, round(x2 * (y2 - y1) * 100, 4) AS area_pct FROM b WHERE x2 * (y2 - y1) * 100 >= 2")
def PF13_area_filter(spark, sf):
    b = F.col("box")
    area = b[2] * (b[3] - b[1]) * 100
    return boxes(spark, sf).where(area >= 2).select("doc_id", F.round(area, 4).alias("area_pct"))


@query("WITH " + TRUTH + " SELECT count(*) FILTER (kind = 'TP')::BIGINT AS tp, round(count(*) FILTER (kind = 'TP' AND toxic = 1) / nullif(count(*) FILTER (kind <> 'FP' AND toxic = 1), 0)::DOUBLE, 4) AS recall_final, round(count(*) FILTER (kind = 'TP' AND toxic = 0) / nullif(count(*) FILTER (kind <> 'FP' AND toxic = 0), 0)::DOUBLE, 4) AS recall_state FROM j LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON j.doc_id = l.doc_id")
def AG3_role_recall(spark, sf):
    role = read(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = truth(spark, sf).join(role, "doc_id", "left")
    tp = lambda v: F.count_if((F.col("kind") == "TP") & (F.col("toxic") == v))
    own = lambda v: F.nullif(F.count_if((F.col("kind") != "FP") & (F.col("toxic") == v)), F.lit(0))
    return d.agg(F.count_if(F.col("kind") == "TP").alias("tp"), F.round(tp(1) / own(1), 4).alias("recall_final"), F.round(tp(0) / own(0), 4).alias("recall_state"))


@query("WITH " + PAIRS + GROUPS + ", z AS (SELECT s, group_id, count(*) AS n FROM k GROUP BY 1, 2) SELECT s, sum(n)::BIGINT AS n_in, count(*)::BIGINT AS n_selected, round(1 - count(*) / sum(n)::DOUBLE, 4) AS compression FROM z GROUP BY 1")
def AG7_selection_summary(spark, sf):
    z = grouped(spark, sf).groupBy("s", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return z.groupBy("s").agg(F.sum("n").alias("n_in"), F.count(F.lit(1)).alias("n_selected"), F.round(1 - F.count(F.lit(1)) / F.sum("n"), 4).alias("compression"))


@query("WITH " + PAIRS + GROUPS + ", n AS (SELECT s, group_id, list(seq ORDER BY seq) AS frames FROM k GROUP BY 1, 2) SELECT s, group_id, unnest(frames) AS seq FROM n")
def PF16_flatten_groups(spark, sf):
    n = grouped(spark, sf).groupBy("s", "group_id").agg(F.array_sort(F.collect_list("seq")).alias("frames"))
    return n.select("s", "group_id", F.explode("frames").alias("seq"))


@query("WITH " + PAIRS + f" SELECT s, seq_a FROM g WHERE (d_jaccard >= {TAU})::INT <> (score >= {TAU})::INT")
def PF9_divergent(spark, sf):
    return pairs(spark, sf).where((F.col("d_jaccard") >= TAU) != (F.col("score") >= TAU)).select("s", "seq_a")


@query("WITH a AS (SELECT doc_id, quality AS role FROM labels), t AS (SELECT doc_id, toxic AS role FROM labels UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT coalesce(a.doc_id, t.doc_id) AS doc_id, coalesce(t.role, a.role)::INT AS role FROM a FULL JOIN t ON a.doc_id = t.doc_id WHERE a.role IS NULL OR t.role IS NULL OR a.role <> t.role")
def PF17_role_toggle(spark, sf):
    """The same role again deletes, another one overwrites: quality is the role held, toxic (1 for documents without a label) the one set."""
    y = read(spark, sf, "labels")
    a = y.select("doc_id", F.col("quality").cast("int").alias("old"))
    bare = read(spark, sf, "documents").select("doc_id").join(y.select("doc_id"), "doc_id", "left_anti")
    t = y.select("doc_id", F.col("toxic").cast("int").alias("new")).unionByName(bare.withColumn("new", F.lit(1)))
    d = a.join(t, "doc_id", "full").where("old is null or new is null or old <> new")
    return d.select("doc_id", F.coalesce("new", "old").alias("role"))


@query("SELECT source, count(*)::BIGINT AS n, max(n_chars) > 3000 AS has_runs FROM documents GROUP BY 1")
def SC11_sessions(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.max("n_chars") > 3000).alias("has_runs"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '[=<>+]') THEN 'formula' WHEN regexp_matches(url, '[A-Za-z]') THEN 'text' ELSE 'other' END AS kind, length(url)::BIGINT AS n FROM pages")
def F18_block_type(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", F.when(u.rlike("[=<>+]"), "formula").when(u.rlike("[A-Za-z]"), "text").otherwise("other").alias("kind"), F.length(u).cast("long").alias("n"))


@query("WITH e AS (SELECT user_id, event_id, value, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM events) SELECT user_id, CASE WHEN max(value) FILTER (part = 4) > 50 THEN 'persistent' WHEN max(value) FILTER (part = 1) > 50 THEN 'transient' ELSE 'settled' END AS pattern FROM e GROUP BY 1")
def AG23_patterns(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").withColumn("part", F.ntile(4).over(w))
    top = lambda k: F.max(F.when(F.col("part") == k, F.col("value")))
    return e.groupBy("user_id").agg(F.when(top(4) > 50, "persistent").when(top(1) > 50, "transient").otherwise("settled").alias("pattern"))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, value FROM events),
 f AS (SELECT user_id, place, row_number() OVER (PARTITION BY user_id ORDER BY place) AS r FROM e WHERE value >= 50 AND place > 0),
 s AS (SELECT user_id, place, r, CASE WHEN place >= 6 THEN place ELSE 0 END AS last, place >= 6 AS kept FROM f WHERE r = 1
 UNION ALL SELECT f.user_id, f.place, f.r, CASE WHEN f.place - s.last >= 6 THEN f.place ELSE s.last END, f.place - s.last >= 6 FROM s JOIN f ON f.user_id = s.user_id AND f.r = s.r + 1)
 SELECT user_id, place::BIGINT AS place FROM s WHERE kept""")
def W5_minimum_gap(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("place"), (F.col("value") >= 50).alias("flag"))
    return bd.spaced(e, "user_id", "place", "flag")


@query("WITH " + FRAMES + """, n AS (SELECT s, count(*) AS n FROM f GROUP BY s), t AS (SELECT s, tok, count(*) AS df FROM (SELECT s, unnest(list_distinct(toks)) AS tok FROM f) GROUP BY s, tok),
 b AS (SELECT t.s, count(*) AS k, bool_or(regexp_matches(tok, 'terminal|console|todo|run|pycharm|vscode|main|py')) AS marked FROM t JOIN n ON t.s = n.s WHERE df / n.n::DOUBLE >= 0.7 GROUP BY t.s)
 SELECT n.s, CASE WHEN k >= 5 AND marked THEN 'ide' WHEN coalesce(k, 0) <= 2 THEN 'blackboard' ELSE 'slides' END AS kind FROM n LEFT JOIN b ON n.s = b.s""")
def G4_session_class(spark, sf):
    f = frames(spark, sf)
    toks = sq.boilerplate(f, "s", "toks").groupBy("s").agg(F.collect_set("tok").alias("bp"))
    return f.select("s").distinct().join(toks, "s", "left").select("s", bd.session_class(F.coalesce("bp", F.array().cast("array<string>"))).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - med) / CASE WHEN q75 = q25 THEN 1 ELSE q75 - q25 END, 6) AS scaled FROM lineitem, (SELECT quantile_cont(l_quantity::DOUBLE, 0.25) AS q25, quantile_cont(l_quantity::DOUBLE, 0.5) AS med, quantile_cont(l_quantity::DOUBLE, 0.75) AS q75 FROM lineitem)")
def M1_robust_scaler(spark, sf):
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"))
    return ml.robust_scale(d, ["x"]).select("l_orderkey", "l_linenumber", F.round("x", 6).alias("scaled"))


@query("SELECT p_partkey, round((p_size - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 6) AS scaled FROM part, (SELECT avg(p_size) AS m, stddev_pop(p_size) AS d FROM part)")
def M2_standard_scaler(spark, sf):
    d = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"))
    return ml.standard_scale(d, ["x"]).select("p_partkey", F.round("x", 6).alias("scaled"))


@query()
def M3_logistic_regression(spark, sf):
    d = read(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    model = ml.fit(d, ["l_quantity", "l_discount", "l_tax"], "y")
    return model.transform(d).groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT conv_id AS s, count(*) AS n, count(DISTINCT role) AS roles FROM conversations GROUP BY 1) SELECT s, n::BIGINT AS n_frames, round(roles / n::DOUBLE, 6) AS complementarity FROM t")
def AG28_complementarity(spark, sf):
    t = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("s")).agg(F.count(F.lit(1)).alias("n_frames"), F.countDistinct("role").alias("roles"))
    return t.select("s", "n_frames", F.round(F.col("roles") / F.col("n_frames"), 6).alias("complementarity"))


@query("WITH " + FRAMES + " SELECT a.s, a.seq AS a, b.seq AS b, CASE WHEN len(a.toks) = 0 AND len(b.toks) = 0 THEN 1.0 WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0.0 ELSE round(len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks)))::DOUBLE, 4) END AS sim FROM f a JOIN f b ON a.s = b.s AND a.seq <> b.seq")
def J8_group_similarities(spark, sf):
    """All pairs of a conversation's turns: the matrix the operator is asked for."""
    f = frames(spark, sf).select("s", "seq", F.array_distinct("toks").alias("t"))
    a, b = f.select("s", F.col("seq").alias("a"), F.col("t").alias("ta")), f.select("s", F.col("seq").alias("b"), F.col("t").alias("tb"))
    both, either = F.size(F.array_intersect("ta", "tb")), F.size(F.array_union("ta", "tb"))
    sim = F.when(either == 0, 1.0).otherwise(F.round(both / either, 4))
    return a.join(b, "s").where("a <> b").select("s", "a", "b", sim.alias("sim"))
