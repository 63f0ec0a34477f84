"""Groups of a stream equal the batch rule, over several micro-batches."""

from chronoweave.streaming import groups


def test_state_spans_batches(spark, tmp_path):
    rows = [("a", 0, ["x"]), ("a", 1, ["x", "y"]), ("b", 0, []), ("a", 2, ["z"]), ("b", 1, None), ("a", 2, ["w"]), ("a", 1, ["late"]), ("b", 2, ["q"]), ("a", 3, ["z"])]
    schema = "s string, seq long, toks array<string>"
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = groups.assign(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).outputMode("append").start()
    assert q.awaitTermination(120)
    got = {(r.s, r.seq): (r.group_id, r.split) for r in spark.read.schema(groups.OUT).parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0): (1, False), ("a", 1): (1, False), ("a", 2): (2, True), ("a", 3): (2, False), ("b", 0): (1, False), ("b", 1): (1, False), ("b", 2): (2, True)}


def test_distance():
    assert groups.distance([], []) == 0 and groups.distance(["a"], []) == 1 and groups.distance(["a", "b"], ["a"]) == 0.5
