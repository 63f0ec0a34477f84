"""Trees grown from sums equal trees grown row by row with the same draws."""

import numpy as np
from pyspark.sql import functions as F

from chronoweave.operators import trees


def grown(x, y, tree, node, level, depth, k, seed, out):
    """One node and all below it, from its own rows."""
    n, ones = len(y), int(y.sum())
    out[node] = (None, 0.0, ones / n if n else 0.0)
    if level == depth or n < 2 or ones in (0, n):
        return
    r = trees.draws(seed, tree, node, x.shape[1] + k)
    order = [f for f in np.argsort(r[: x.shape[1]], kind="stable") if x[:, f].min() < x[:, f].max()][:k]
    best = None
    for c, f in enumerate(order):
        cut = x[:, f].min() + r[x.shape[1] + c] * (x[:, f].max() - x[:, f].min())
        right = x[:, f] > cut
        if right.any() and not right.all():
            impurity = sum(2 * y[s].sum() * (s.sum() - y[s].sum()) / s.sum() for s in (right, ~right))
            if best is None or impurity < best[0] - 1e-9:
                best = (impurity, f, cut, right)
    if best:
        _, f, cut, right = best
        out[node] = (f, cut, ones / n)
        grown(x[~right], y[~right], tree, 2 * node, level + 1, depth, k, seed, out)
        grown(x[right], y[right], tree, 2 * node + 1, level + 1, depth, k, seed, out)


def test_equal_to_row_by_row(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5)).round(2)
    x[:, 4] = 7.0  # one value only
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0) ^ (rng.random(400) < 0.1)).astype(int)
    rows = [(*map(float, r), int(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 7.0, 1), (1.0, 1.0, 1.0, 1.0, 7.0, None)], "a double, b double, c double, d double, e double, label int").repartition(3)
    names = ["a", "b", "c", "d", "e"]
    forest = trees.fit(df, names, "label", trees=4, depth=4, candidates=3, seed=9)
    for t in range(4):
        want = {}
        grown(x, y, t, 1, 0, 4, 3, 9, want)
        for node, (f, cut, share) in want.items():
            assert forest.feature[t, node] == (-1 if f is None else f) and abs(forest.share[t, node] - share) < 1e-12
            assert f is None or abs(forest.threshold[t, node] - cut) < 1e-12
    got = trees.transform(df, forest).collect()
    assert [r["probability"] is None for r in got].count(True) == 1
    known = {tuple(r[:5]): r["probability"] for r in got if r["probability"] is not None}
    for r in x:
        assert abs(known[tuple(map(float, r))] - forest.probability(r[None])[0]) < 1e-12
    deep = trees.transform(df.dropna(), trees.fit(df, names, "label", trees=20, depth=6))
    assert deep.where("prediction = label").count() / 400 > 0.8
    assert (trees.fit(df.repartition(7), names, "label", trees=4, depth=4, candidates=3, seed=9).threshold == forest.threshold).all()
    none = trees.fit(df.limit(0), names, "label", trees=2, depth=2)
    assert (none.feature == -1).all() and (none.share == 0).all()


def test_thresholds(spark):
    df = spark.createDataFrame([("math", "extra", 0.2), ("math", "forest", 0.09), ("slides", "logistic", 0.75), ("other", "logistic", 0.5), (None, "x", 0.4)], "domain string, model string, score double")
    got = [(r["threshold"], r["decision"]) for r in trees.decided(df, "domain", "model", "score").orderBy(F.desc("score")).collect()]
    assert got == [(0.76, 0), (0.5, 1), (0.5, 0), (0.2, 1), (0.1, 0)]


def test_rows_are_not_dealt_by_their_class(spark):
    from chronoweave.operators import learning

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        d = learning.balanced(spark.range(90).selectExpr("id", "cast(id % 3 = 0 as int) as y"), "y")
        assert "SortMergeJoin" not in d._jdf.queryExecution().executedPlan().toString()
        assert {(r["y"], r["weight"]) for r in d.collect()} == {(0, 0.75), (1, 1.5)}
    finally:
        spark.conf.set(key, before)
