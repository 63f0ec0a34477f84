"""Splits keep every stratum's share, do not depend on the partitioning and send a key one way."""

from pyspark.sql import functions as F

from chronoweave.operators import sampling


def test_stratified(spark):
    rows = [(i, ["a", "a", "a", "b", None][i % 5], "clash") for i in range(203)] + [(500, "one", "clash"), (None, "b", "clash"), (None, "b", "clash")]
    df = spark.createDataFrame(rows, "k long, s string, n string")
    got = sampling.stratified(df.repartition(5), "s", "k", 0.25, 7)
    assert got.columns == ["k", "s", "n", "test"] and got.count() == len(rows)
    per = {r["s"]: (r["c"], r["t"]) for r in got.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.sum("test").alias("t")).collect()}
    for s, (n, t) in per.items():
        assert 0 <= t - int(n * 0.25 + 0.5) <= 1, s  # rows without a key share a lot
    pick = lambda d: {(r["k"], r["s"]) for r in d.where("test = 1").collect()}
    assert pick(got) == pick(sampling.stratified(df.repartition(2), "s", "k", 0.25, 7)) != pick(sampling.stratified(df, "s", "k", 0.25, 8))
    assert sampling.stratified(df.limit(0), "s", "k").count() == 0 and pick(sampling.stratified(df, "s", "k", 0.0)) == set()
