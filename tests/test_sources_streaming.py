"""Readers, writers and streaming twins."""

from pyspark.sql import functions as F

from chronoweave.sources import readers, writers
from chronoweave.streaming import windows

SF = "/root/testdata/sf0.001"


def test_versioned_and_truth(spark, tmp_path):
    d = spark.createDataFrame([("a", "b", "1", " "), ("b", "c", "", "x"), ("c", "d", "0", "y")], "frame_a string, frame_b string, label string, researcher_note string")
    root = str(tmp_path / "set")
    assert writers.versioned(d, root) == root and writers.versioned(d, root) == root + "_v1"
    got = readers.transition_truth(readers.csv_table(spark, root, d.schema.simpleString()[7:-1].replace(":", " "))).collect()
    assert sorted((r["frame_a"], r["label"], r["note"]) for r in got) == [("a", 1, None), ("c", 0, "y")]


def test_keyframe_truth(spark):
    rows = [(1, "f1", "1", "final", ""), (2, "f1", "1", "state", "A2"), (3, "f2", "0", "final", ""), (4, "f3", "1", "other", ""), (5, "f4", "1", "final", "B2")]
    d = spark.createDataFrame(rows, "k int, frame_filename string, is_keyframe string, role_type string, partition_name string")
    got = readers.keyframe_truth(d, F.col("k"), "A2").collect()
    assert [(r["frame_filename"], r["role_type"]) for r in got] == [("f1", "state")]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("twin").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r["start"], r["event_type"], r["n"], round(r["total"], 6))
    assert sorted(map(key, spark.table("twin").collect())) == sorted(map(key, windows.tumbling(batch, "ts", "event_type", "value").collect()))
