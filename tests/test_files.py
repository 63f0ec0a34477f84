"""Readers and writers of files: pictures, listings, saved sessions, labels, routed frames."""

import os
import struct
import zlib

from chronoweave.sources import readers, writers


def png(path, rows):
    """A gray PNG of rows of bytes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b""))


def test_pictures(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    png(tmp_path / "b" / "frame_0002.png", [[0, 255], [7, 8], [9, 10]])
    png(tmp_path / "b" / "frame_0001.PNG", [[1]])
    (tmp_path / "b" / "broken.jpg").write_bytes(b"no picture")
    (tmp_path / "b" / "notes.txt").write_text("x")
    folder = str(tmp_path / "b")
    files = {r["filename"]: r["length"] for r in readers.image_files(spark, folder).collect()}
    assert set(files) == {"frame_0001.PNG", "frame_0002.png", "broken.jpg"} and files["broken.jpg"] == 10
    got = {r["filename"]: r for r in readers.images(spark, folder).collect()}
    assert set(got) == {"frame_0001.PNG", "frame_0002.png"} and (got["frame_0002.png"]["height"], got["frame_0002.png"]["width"]) == (3, 2) and bytes(got["frame_0002.png"]["data"]) == bytes([0, 255, 7, 8, 9, 10])
    assert readers.first_folder(spark, [str(tmp_path / "none"), str(tmp_path / "a"), folder]) == folder and readers.first_folder(spark, [str(tmp_path / "a")]) is None


def test_listings_and_sessions(spark, tmp_path):
    for k, (name, text) in enumerate([("session_b/z.csv", "1"), ("session_b/a.csv", "2"), ("session_b/feature_manifest.json", "{}"), ("session_b/run.json", "{}"), ("session_a/x.csv", "3"), ("session_c/only.json", "{}"), ("other/y.csv", "4"), ("session_b/deep/w.csv", "5")]):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
    newest = [r["path"].rsplit("/", 1)[-1] for r in readers.newest_files(spark, [str(tmp_path / "session_b"), str(tmp_path / "session_a"), str(tmp_path / "session_b" / "deep")]).collect()]
    assert newest == ["w.csv", "x.csv", "a.csv", "z.csv"]
    found = [(r["session"], r["csv"].rsplit("/", 1)[-1], r["json"] and r["json"].rsplit("/", 1)[-1]) for r in readers.saved_sessions(spark, str(tmp_path)).collect()]
    assert found == [("session_a", "x.csv", None), ("session_b", "a.csv", "run.json")]
    assert readers.saved_sessions(spark, str(tmp_path / "none")).count() == 0


def test_labels_and_routed_frames(spark, tmp_path):
    d = spark.createDataFrame([(2, 5, "f2", None), (1, 9, "f3", 1), (1, 3, "f1", 0)], "group_id int, timestamp_sec int, frame_filename string, prediction int")
    writers.keyframes(d, str(tmp_path / "k"))
    text = [line for p in sorted((tmp_path / "k").glob("part*")) for line in p.read_text().splitlines() if not line.startswith("group_id")]
    assert text == ["1,3,f1,0", "1,9,f3,1", "2,5,f2,"]
    writers.routed(d, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["prediction=0", "prediction=1", "prediction=__HIVE_DEFAULT_PARTITION__"]
    back = readers.csv_table(spark, str(tmp_path / "k"), "group_id int, timestamp_sec int, frame_filename string, prediction int")
    assert sorted(map(str, back.collect())) == sorted(map(str, d.collect()))


def test_groups_are_made_once_for_all_snapshots(spark, monkeypatch):
    from pyspark.sql import functions as F

    from chronoweave.plans import runs

    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(n):
        made.add(1)
        return n

    rows = spark.createDataFrame([(a, 1, g) for a in ("A1", "A2", "B2") for g in (1, 2)], "approach string, session long, group_id long")
    monkeypatch.setattr(runs.gr, "summaries", lambda f: rows.withColumn("frame_count", counted("group_id")))
    got = {(r["snapshot_id"], r["num_groups"]) for r in runs.SK7_SC9_snapshot_listing(spark, "/root/testdata/sf0.001").collect()}
    assert got == {("run_20240101_000000", 2), ("run_20240101_000002", 2)} and made.value == 6
