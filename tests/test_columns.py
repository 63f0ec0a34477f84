"""Small column functions on odd values."""

from pyspark.sql import functions as F

from chronoweave.functions import raster
from chronoweave.functions import vectors as vec
from chronoweave.operators import anova
from chronoweave.operators.layout import cells


def test_large_boxes(spark):
    small, turned, big = [0.0, 0.0, 0.1, 0.1], [0.9, 0.9, 0.1, 0.1], [0.0, 0.0, 0.5, 0.5]
    df = spark.createDataFrame([(0, [small, big, [0.1, 0.2]]), (1, [small, small, turned]), (2, []), (3, None), (4, [turned])], "i int, b array<array<double>>")
    got = {r["i"]: (r["k"], r["n"]) for r in df.select("i", raster.large(F.col("b")).alias("k"), raster.large(F.col("b"), keep_largest=False).alias("n")).collect()}
    assert got == {0: ([big], [big]), 1: ([small], []), 2: ([], []), 3: ([], []), 4: ([turned], [])}


def test_cells_of_many_boxes(spark):
    df = spark.createDataFrame([([[0.0, 0.0, 0.07, 0.07], [0.5, 0.5, 1.0, 0.5], [-3.0, 0.99, 0.0, 9.0]],)], "b array<array<double>>")
    got = df.select(F.array_distinct(F.flatten(F.transform("b", lambda x: cells(x)))).alias("c")).first()["c"]
    assert set(got) == {0, 1, 16, 17} | {x * 16 + 8 for x in range(8, 16)} | {15}


def test_distances_and_histograms(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vec.unit_distance(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0]
    h = spark.createDataFrame([([0.5, 0.5],), ([0.5, 0.500001],), ([0.5, 0.6],), ([1.5, -0.5],), ([float("nan"), 1.0],), ([float("inf")],), ([None, 1.0],), ([],), (None,)], "h array<double>")
    assert [r[0] for r in h.select(vec.is_histogram(F.col("h"))).collect()] == [True, True] + [False] * 7


def test_f_scores(spark):
    rows = [("a", 1e9 + 1.0, 5.0, 1.0), ("a", 1e9 + 2.0, 5.0, None), ("b", 1e9 + 8.0, 5.0, 2.0), ("b", 1e9 + 9.0, 5.0, 2.5), (None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "y string, far double, flat double, gap double")
    got = {r["feature"]: r["score"] for r in anova.f_scores(df, ["far", "flat", "gap"], "y").collect()}
    assert abs(got["far"] - 49 / 0.5) < 1e-6 and got["flat"] == float("inf") and abs(got["gap"] - (1.25**2 * 2 / 3) / 0.125) < 1e-9
    assert anova.select_k_best(df, ["far", "flat", "gap"], "y", 2) == ["flat", "far"]
    assert anova.f_scores(df.where("y = 'a'"), ["far"], "y").first()["score"] is None and anova.f_scores(df.limit(0), ["far"], "y").count() == 0
