"""Curves, reports and schema unions on odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import curves, ranks, schemas


def test_areas(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 1, None]), rng.choice([None, float("nan"), -3.0, 0.0, 1e9]) if rng.random() < 0.2 else rng.choice([rng.random(), 0.5, 0.25])) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, x double").repartition(3)
    good = [(y, x) for y, x in rows if y is not None and x is not None and x == x]
    pos, neg = [x for y, x in good if y], [x for y, x in good if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap = sum(sum(q >= p for q in pos) / sum(q >= p for _, q in good) for p in pos) / len(pos)
    r = curves.areas(df, "y", "x").first()
    assert abs(r["auc"] - auc) < 1e-9 and abs(r["average_precision"] - ap) < 1e-9 and (r["positives"], r["negatives"]) == (len(pos), len(neg))
    assert tuple(curves.areas(df.limit(0), "y", "x").first()) == (None, None, 0, 0)
    assert curves.areas(df.where("y = 1"), "y", "x").first()["auc"] is None


def test_report(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1), (0, 0.2), (None, 0.3), (1, None)], "y int, x double")
    got = {(r["threshold"], r["class"]): tuple(round(v, 4) for v in (r["precision"], r["recall"], r["f1"])) + (r["support"],) for r in curves.report(df, "y", "x", [0.5, 2.0]).collect()}
    assert got[0.5, "1"] == (0.5, 0.5, 0.5, 2) and got[0.5, "0"] == (0.6667, 0.6667, 0.6667, 3) and got[0.5, "accuracy"][0] == 0.6
    assert got[2.0, "1"] == (0.0, 0.0, 0.0, 2) and got[2.0, "0"] == (0.6, 1.0, 0.75, 3) and got[2.0, "macro avg"] == (0.3, 0.5, 0.375, 5) and got[2.0, "weighted avg"] == (0.36, 0.6, 0.45, 5)
    assert {r["support"] for r in curves.report(df.limit(0), "y", "x").collect()} == {0}


def test_compatibility_and_combine(spark):
    a = spark.createDataFrame([(1, "x", 2.0)], "id int, label string, only_a double")
    b = spark.createDataFrame([("y", 2, None)], "target string, id bigint, GroundTruth int")
    r = schemas.compatibility({"a": a, "b": b})
    assert r.common == ("id",) and r.every == ("id", "label", "only_a", "target", "GroundTruth") and r.missing == {"a": ("target", "GroundTruth"), "b": ("label", "only_a")}
    assert r.compatible and not r.identical and r.labels == {"a": "label", "b": "GroundTruth"} and schemas.compatibility({"a": a}).identical
    assert sorted(map(tuple, schemas.combine({"a": a, "b": b}, r).collect())) == [(1, "a"), (2, "b")]
    every = schemas.combine({"a": a, "b": b}, r, "all", fill=0)
    assert [tuple(x) for x in every.orderBy("id").collect()] == [(1, "x", 2.0, "0", 0, "a"), (2, "0", 0.0, "y", None, "b")]  # what was null in its own table stays null
    clash = schemas.compatibility({"a": a, "b": b.withColumn("label", F.array(F.lit(1)))})
    assert clash.conflicts == {"label": {"a": "string", "b": "array<int>"}} and not clash.compatible
    for bad in (lambda: schemas.combine({"a": a, "b": b.withColumn("label", F.array(F.lit(1)))}, clash), lambda: schemas.combine({"a": a}, r, "some"), lambda: schemas.combine({"a": a}, schemas.compatibility({"a": a}), tag="id"), lambda: schemas.compatibility({})):
        with pytest.raises(ValueError):
            bad()


def test_first_of_equal_and_numbers(spark):
    rows = [(1, None, "b"), (1, None, "a"), (1, None, "b"), (2, "x", "z"), (2, "x", "b"), (3, "q", None)]
    d = spark.createDataFrame(rows, "k int, v string, tag string")
    kept = schemas.first_of_equal(d, "tag", ["a", "b"])
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, None, "a"), (2, "x", "b"), (3, "q", None)]
    many = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    got = schemas.numbered(many, ["k"], "n", 5).collect()
    assert [(r["k"], r["v"]) for r in sorted(got, key=lambda r: r["n"])] == sorted((i % 7, i) for i in range(500)) and sorted(r["n"] for r in got) == list(range(1, 501))
    assert schemas.numbered(many.limit(0), ["k"], "n").count() == 0


def test_columns_by_name():
    c = ["FrameA_Brightness", "FrameB_Edge", "GroundTruth", "SSIM_Mean", "Gray_Hist_Dist_Bhattacharyya", "Grid_Edge_Diff", "Global_RGB_Hist_Mean", "MAD"]
    assert schemas.deltas(c) == c[3:] and schemas.pruned(c) == c[3:6]
    assert [schemas.kind(x) for x in c] == ["brightness", "edge density", "other", "structural similarity", "histogram comparison", "edge density", "histogram", "other"]


def test_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, float("nan")]) if rng.random() < 0.1 else rng.choice([1e12, -1e12, 7.0, 7.0, 7.0, rng.random()]), rng.randrange(5)) for _ in range(600)] + [("only null", None, None), ("one", 3.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, k int").repartition(3)
    shares = [0.0, 0.05, 0.25, 0.5, 0.99, 1.0]
    got = {(r["g"], r["feature"]): r["q"] for r in ranks.quantiles(df, ["x", "k"], shares, ["g"]).collect()}
    for g in ("a", "b", "c", None, "one"):
        x = [v for h, v, _ in rows if h == g and v is not None and v == v]
        assert np.allclose(got[g, "x"], np.quantile(x, shares), rtol=1e-12) and np.allclose(got[g, "k"], np.quantile([k for h, _, k in rows if h == g], shares))
    assert not any(g == "only null" for g, _ in got)
    whole = ranks.one_row(ranks.quantiles(df, ["x"], shares), ["x"]).first()["x"]
    assert np.allclose(whole, np.quantile([v for _, v, _ in rows if v is not None and v == v], shares), rtol=1e-12)
    assert ranks.one_row(ranks.quantiles(df.limit(0), ["x"], shares), ["x"]).first()["x"] is None
    for n in (1, 2, 64):
        c = spark.range(500).select((F.col("id") * F.col("id")).alias("v"), F.lit(1).cast("long").alias("n"))
        assert [r["below_n"] for r in ranks.with_below(c, [], "v", ["n"], n).orderBy("v").collect()] == list(range(500))
