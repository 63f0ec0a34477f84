"""The snapshot store through crashes, and the stream that answers one frame late."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.sources import store as st
from chronoweave.streaming import lookahead


def test_round_trip_and_immutability(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "runs"))
    assert s.list().count() == 0 and s.load("run_x", "t") is None and not s.delete("run_x") and not s.intact("run_x")
    d = spark.createDataFrame([(1, "a", [1.0]), (2, None, None)], "k int, v string, l array<double>")
    a = s.save({"t": d, "none": d.limit(0)}, " first ", {"groups_a1": 3}, {"tau": "0.35"}, datetime(2024, 1, 1, 0, 0, 1))
    b = s.save({"t": d.union(d)}, "  ", now=datetime(2024, 1, 1, 0, 0, 2))
    assert (a, b) == ("run_20240101_000001", "run_20240101_000002")
    rows = s.list().collect()
    assert [(r["snapshot_id"], r["tag"], r["tables"]) for r in rows] == [(b, "Snapshot 20240101_000002", {"t": 4}), (a, "first", {"t": 2, "none": 0})]
    assert rows[1]["numbers"] == {"groups_a1": 3} and rows[1]["config"] == {"tau": "0.35"}
    assert sorted(map(tuple, s.load(a, "t").collect()), key=str) == sorted(map(tuple, d.collect()), key=str) and s.load(a, "none").count() == 0 and s.load(a, "other") is None
    with pytest.raises(FileExistsError):
        s.save({"t": d}, now=datetime(2024, 1, 1, 0, 0, 1))
    assert s.intact(a) and s.intact(b)
    assert s.delete(a) and not s.delete(a) and s.load(a, "t") is None and [r["snapshot_id"] for r in s.list().collect()] == [b]


def test_cut_off_runs_are_invisible(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "runs")
    s = st.Store(spark, root)
    d = spark.range(5)
    good = s.save({"t": d}, "good", now=datetime(2024, 1, 1))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # the run dies between its tables and its manifest
        m.setattr(st.Store, "_publish", stop)
        with pytest.raises(KeyboardInterrupt):
            s.save({"t": d}, "dead", now=datetime(2024, 1, 2))
    with monkeypatch.context() as m:  # and one in the middle of its tables
        m.setattr(st, "fingerprint", stop)
        with pytest.raises(KeyboardInterrupt):
            s.save({"t": d}, "dead too", now=datetime(2024, 1, 3))
    assert os.path.isdir(f"{root}/data/run_20240102_000000") and s.load("run_20240102_000000", "t") is None
    with open(f"{root}/manifests/run_broken.json", "w") as f:
        f.write('{"snapshot_id": "run_bro')
    with open(f"{root}/manifests/run_bare.json", "w") as f:
        json.dump({"snapshot_id": "run_bare"}, f)
    assert [(r["snapshot_id"], r["tag"], r["saved_at"], r["numbers"]) for r in s.list().collect()] == [("run_bare", "Unnamed Run", "Unknown", {}), (good, "good", "2024-01-01 00:00:00", {})]
    assert s.save({"t": d}, "again", now=datetime(2024, 1, 2)) == "run_20240102_000000" and s.intact("run_20240102_000000")  # what was left over does not stand in the way
    assert s.sweep() >= 1 and s.intact(good) and s.intact("run_20240102_000000")


def test_damage_is_seen(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "runs"))
    k = s.save({"t": spark.range(9).repartition(3)}, now=datetime(2024, 1, 1))
    folder = tmp_path / "runs" / "data" / k / "t"
    next(p for p in sorted(folder.iterdir()) if p.name.startswith("part") and spark.read.parquet(str(p)).count()).unlink()
    assert not s.intact(k)


def test_feature_cache(spark, tmp_path):
    c = st.FeatureCache(spark, str(tmp_path / "cache"))
    source = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert c.get(source) is None
    frames, transitions = source.withColumn("n", F.lit(1)), source.limit(1)
    key = c.put(source, frames, transitions)
    assert c.put(source.orderBy(F.desc("k")), frames.limit(0), transitions) == key  # the same contents: nothing is written again
    assert c.get(source)["frames"].count() == 2 and c.get(source)["transitions"].count() == 1
    assert c.get(source.where("k = 1")) is None and c.get(source.withColumn("v", F.lit("a"))) is None  # as many rows are not enough
    st.flat(spark.createDataFrame([(1, "f1", 0.5, None)], "pair_idx int, frame_a string, d_ssim double, ocr_loss double").coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part*")).read_text().splitlines()
    assert text[0].split(",") == list(st.FLAT) and len(st.FLAT) == 21 and text[1] == "1,f1" + "," * 9 + ",0.5" + "," * 9


def frames_of(seed):
    rng = random.Random(seed)
    start, rows = datetime(2024, 1, 1), []
    for s in ("a", "b", "c"):
        base = [f"w{i}" for i in range(6)]
        for q in range(14):
            if rng.random() < 0.15:
                base = [f"{s}{rng.randrange(99)}" for _ in range(6)]
            toks = base + ([f"x{i}" for i in range(20)] if rng.random() < 0.25 else [])
            rows.append((s, start + timedelta(seconds=10 * q + rng.randrange(3)), rng.choice([toks] * 7 + [[]]) if rng.random() < 0.95 else None, rng.choice([0, 1, 4, 6])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_on_shuffled_batches(spark, tmp_path, seed):
    rows = frames_of(seed)
    schema = "s string, ts timestamp, toks array<string>, boxes int"
    # Frames come up to 30 seconds out of order and some twice; a last frame far ahead ends the sessions.
    rng = random.Random(seed)
    arriving = sorted(rows + rng.sample(rows, 6), key=lambda r: r[1] + timedelta(seconds=rng.randrange(30)))
    parts = [arriving[i : i + 9] for i in range(0, len(arriving), 9)]
    end = datetime(2024, 1, 1, 6)
    parts += [[("end", end, [], 0)], [("end", end + timedelta(seconds=1), [], 0)], [("end", end + timedelta(seconds=2), [], 0)]]
    for i, part in enumerate(parts):
        at = tmp_path / "in" / f"{i:03d}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(at))
        for p in at.glob("part*"):
            os.rename(p, tmp_path / "in" / f"{i:03d}.parquet")
            os.utime(tmp_path / "in" / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*.parquet"))
    q = lookahead.answers(stream, "60 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).outputMode("append").start()
    assert q.awaitTermination(280)
    key = lambda r: (r["s"], r["ts"], r["split"], r["popup"], r["reset"], r["group_id"])
    got = sorted(key(r) for r in spark.read.schema(lookahead.OUT).parquet(str(tmp_path / "out")).collect() if r["s"] != "end")
    want = sorted(key(r) for r in lookahead.batch(spark.createDataFrame(rows, schema)).collect())
    assert got == want
    assert any(r[3] for r in want) and any(r[4] for r in want) and any(r[2] for r in want)
