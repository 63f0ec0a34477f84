"""Persistence of what frames show.  Frames are turns of conversations; label 1 of frame ``8 * conv_id + turn`` is the truth (GT), label 0 a wrong choice (FP), none ordinary (ORD)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.operators import persistence as ps
from chronoweave.plans.registry import query, read

STEPS = (1, 3, 5, 10, 20)


def frames(spark, sf) -> DataFrame:
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("s"), F.col("turn").alias("seq"), tx.tokenize(tx.ascii_only("text")).alias("tokens"))
    y = read(spark, sf, "labels").select(F.col("doc_id").alias("frame"), "quality")
    kind = F.when(F.col("quality") == 1, "GT").when(F.col("quality") == 0, "FP").otherwise("ORD")
    return c.withColumn("frame", 8 * F.col("s") + F.col("seq")).join(y, "frame", "left").select("s", "seq", "tokens", kind.alias("kind"))


def _sql(pairs: str) -> str:
    """CTE ``dist`` (s, seq, name, d) for the rows (s, seq, name, a, b) of a query: matching blocks, longest first.

    A block starts at a run of equal tokens none of which is popular in b, and
    is then drawn out over any equal tokens (without such a run, the tokens at
    the very start are); what is left and right of it is searched next.
    """
    return (
        r"""f AS (SELECT conv_id AS s, turn AS seq, CASE quality WHEN 1 THEN 'GT' WHEN 0 THEN 'FP' ELSE 'ORD' END AS kind,
  regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '_', 'g')), '\b[a-zA-Z0-9_\-\$]+\b') AS t FROM conversations LEFT JOIN labels ON doc_id = 8 * conv_id + turn),
 pr AS ("""
        + pairs
        + """),
 ok AS (SELECT row_number() OVER () AS id, s, seq, name, a, b FROM pr WHERE a IS NOT NULL AND b IS NOT NULL),
 xa AS (SELECT id, unnest(a) AS tok, generate_subscripts(a, 1) - 1 AS i FROM ok), xb AS (SELECT id, unnest(b) AS tok, generate_subscripts(b, 1) - 1 AS j FROM ok),
 pop AS (SELECT id, tok FROM xb JOIN (SELECT id, len(b) AS n FROM ok) USING (id) GROUP BY id, tok, n HAVING n >= 200 AND count(*) > n // 100 + 1),
 eq AS (SELECT xa.id, i, j, pop.tok IS NOT NULL AS popular FROM xa JOIN xb ON xa.id = xb.id AND xa.tok = xb.tok LEFT JOIN pop ON pop.id = xa.id AND pop.tok = xa.tok),
 run AS (SELECT id, i, j, popular, row_number() OVER (PARTITION BY id, i - j, k ORDER BY i) - 1 AS left_, count(*) OVER (PARTITION BY id, i - j, k) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS k FROM eq)),
 clean AS (SELECT id, i, j, row_number() OVER (PARTITION BY id, i - j, k ORDER BY i DESC) AS plain FROM (SELECT *, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS k FROM eq WHERE NOT popular)),
 m AS (SELECT r.id, r.i, r.j, coalesce(c.plain, 0) AS plain, r.left_, r.n - r.left_ AS right_ FROM run r LEFT JOIN clean c ON c.id = r.id AND c.i = r.i AND c.j = r.j),
 seg AS (SELECT id, 0::BIGINT AS alo, len(a)::BIGINT AS ahi, 0::BIGINT AS blo, len(b)::BIGINT AS bhi, 0::BIGINT AS k FROM ok
  UNION ALL SELECT id, u.alo, u.ahi, u.blo, u.bhi, u.k FROM (
   SELECT id, unnest([{'alo': alo, 'ahi': x, 'blo': blo, 'bhi': y, 'k': 0}, {'alo': x + size, 'ahi': ahi, 'blo': y + size, 'bhi': bhi, 'k': 0}, {'alo': 0, 'ahi': 0, 'blo': 0, 'bhi': 0, 'k': size}]) AS u FROM (
    SELECT id, alo, ahi, blo, bhi, best.i - least(best.left_, best.i - alo, best.j - blo) AS x, best.j - least(best.left_, best.i - alo, best.j - blo) AS y,
     least(best.left_, best.i - alo, best.j - blo) + least(best.right_, ahi - best.i, bhi - best.j) AS size FROM (
     SELECT s.id, alo, ahi, blo, bhi, arg_max({'i': m.i, 'j': m.j, 'left_': left_, 'right_': right_}, least(plain, ahi - m.i, bhi - m.j) * 100000000 - m.i * 10000 - m.j) AS best
     FROM seg s JOIN m ON m.id = s.id AND m.i >= alo AND m.i < ahi AND m.j >= blo AND m.j < bhi AND (plain > 0 OR (m.i = alo AND m.j = blo)) WHERE s.k = 0 GROUP BY ALL))) WHERE u.k > 0 OR (u.alo < u.ahi AND u.blo < u.bhi)),
 dist AS (SELECT ok.s, ok.seq, ok.name, CASE WHEN len(a) + len(b) = 0 THEN 0.0::DOUBLE ELSE 1 - 2 * g.k / (len(a) + len(b))::DOUBLE END AS d FROM ok JOIN (SELECT id, sum(k) AS k FROM seg GROUP BY 1) g USING (id))"""
    )


_W = "WINDOW w AS (PARTITION BY s ORDER BY seq)"
_AHEAD = " UNION ALL ".join(f"SELECT s, seq, 'd{n}' AS name, t AS a, lead(t, {n}) OVER w AS b FROM f {_W}" for n in STEPS)


@query("WITH RECURSIVE " + _sql(f"SELECT s, seq, 'd1' AS name, t AS a, lead(t) OVER w AS b FROM f {_W}") + " SELECT s, seq, round(d, 6) AS d FROM dist")
def F16_edit_distance(spark, sf):
    return ps.distances(frames(spark, sf), "s", "seq", "tokens", [1]).where("d1 is not null").select("s", "seq", F.round("d1", 6).alias("d"))


@query("WITH RECURSIVE " + _sql(_AHEAD) + " SELECT kind, name, count(*)::BIGINT AS n, round(avg(d), 6) AS mean FROM dist JOIN f USING (s, seq) GROUP BY 1, 2")
def W8_persistence(spark, sf):
    """Mean distance to the frame 1, 3, 5, 10 and 20 places later, by kind of frame."""
    d = ps.distances(frames(spark, sf), "s", "seq", "tokens", STEPS, keep=["kind"])
    each = F.explode(F.array(*[F.struct(F.lit(f"d{n}").alias("name"), F.col(f"d{n}").alias("d")) for n in STEPS])).alias("x")
    return d.select("kind", each).where("x.d is not null").groupBy("kind", F.col("x.name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x.d"), 6).alias("mean"))


_AROUND = f"SELECT s, seq, 'before' AS name, lag(t, 2) OVER w AS a, t AS b FROM f {_W} UNION ALL SELECT s, seq, 'after', t, lead(t, 2) OVER w FROM f {_W} UNION ALL SELECT s, seq, 'across', lag(t, 2) OVER w, lead(t, 2) OVER w FROM f {_W}"
_PIVOT = ", p AS (SELECT s, seq, max(d) FILTER (name = 'before') AS before, max(d) FILTER (name = 'after') AS after, max(d) FILTER (name = 'across') AS across FROM dist GROUP BY 1, 2 HAVING count(*) = 3)"


@query("WITH RECURSIVE " + _sql(_AROUND) + _PIVOT + " SELECT s, seq, kind, round(before, 6) AS before, round(after, 6) AS after, round(across, 6) AS across FROM p JOIN f USING (s, seq)")
def W9_neighbourhood(spark, sf):
    """Distances two places back, two ahead, and across; sessions are short here, so two stands for the wider steps."""
    d = ps.distances(frames(spark, sf), "s", "seq", "tokens", [-2, 2], [(2, 2)], ["kind"]).where("b2_2 is not null")
    return d.select("s", "seq", "kind", F.round("d_2", 6).alias("before"), F.round("d2", 6).alias("after"), F.round("b2_2", 6).alias("across"))


@query("WITH RECURSIVE " + _sql(_AROUND) + _PIVOT + """ SELECT kind, CASE WHEN kind = 'GT' THEN CASE WHEN after < 0.05 AND before > 0.05 THEN 'settled' WHEN after > 0.05 AND before > 0.05 THEN 'transition' WHEN after > 0.05 AND before < 0.05 THEN 'pre-transition' ELSE 'continuous' END
 ELSE CASE WHEN across < 0.05 AND before > 0.05 THEN 'transient' WHEN after < 0.05 AND before > 0.05 THEN 'persistent' WHEN before > 0.05 AND after > 0.05 THEN 'evolving' ELSE 'continuous' END END AS pattern, count(*)::BIGINT AS n FROM p JOIN f USING (s, seq) WHERE kind <> 'ORD' GROUP BY 1, 2""")
def AG23_pattern_counts(spark, sf):
    d = ps.distances(frames(spark, sf), "s", "seq", "tokens", [-2, 2], [(2, 2)], ["kind"]).where("b2_2 is not null and kind <> 'ORD'")
    pattern = F.when(F.col("kind") == "GT", ps.truth_pattern(F.col("d_2"), F.col("d2"))).otherwise(ps.chosen_pattern(F.col("d_2"), F.col("d2"), F.col("b2_2")))
    return d.groupBy("kind", pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
