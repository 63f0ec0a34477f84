"""Boundary rules and classifiers on small tables."""

from chronoweave.operators import boundaries as bd
from chronoweave.operators import learning as ml


def test_rules_by_class(spark):
    # boxes of frames 0..8: resets at 3 and 7; 3 comes too early.
    boxes = [4, 4, 4, 0, 4, 4, 4, 1, 1]
    rows = [("i", k, 1, "ide", b, 0.0) for k, b in enumerate(boxes)]
    rows += [("b", 0, 1, "blackboard", 0, 0.7), ("b", 1, 1, "blackboard", 0, 0.69), ("b", 2, 0, "blackboard", 0, None), ("s", 0, 1, "slides", 0, 1.0)]
    df = spark.createDataFrame(rows, "s string, seq long, pred int, kind string, boxes long, share double")
    got = {(r.s, r.seq): r.pred for r in bd.correct(df, "s", "seq", "pred", "kind", "boxes", "share").collect()}
    assert len(got) == len(rows)
    assert [k for k in range(9) if got["i", k]] == [6]
    assert [got["b", k] for k in range(3)] == [0, 1, 0] and got["s", 0] == 1
    assert bd.correct(df.limit(0), "s", "seq", "pred", "kind", "boxes", "share").count() == 0


def test_spaced_takes_the_gap_from_the_last_kept(spark):
    df = spark.createDataFrame([("a", k, k in (2, 6, 9, 12, 13, 18)) for k in range(20)], "s string, place long, flag boolean")
    assert sorted(r.place for r in bd.spaced(df, "s", "place", "flag").collect()) == [6, 12, 18]


def test_models_separate_classes(spark):
    df = spark.createDataFrame([(float(k), float(k % 7), float(k >= 40)) for k in range(50)], "a double, b double, y double")
    assert {round(r.weight, 3) for r in ml.balanced(df, "y").collect()} == {0.625, 2.5}
    assert "a*b" in ml.interactions(df, ["a", "b"]).columns
    for kind in ("logistic", "forest"):
        out = ml.fit(df, ["a", "b"], "y", kind).transform(df)
        assert out.where("prediction = y").count() >= 47
