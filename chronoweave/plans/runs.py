"""Runs that are kept: the feature cache and snapshots of groupings, written to the shared folder and read back."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import grouping as gr
from chronoweave.plans import lessons
from chronoweave.plans.registry import query, read
from chronoweave.sources.store import FeatureCache, Store, checkpointed, shared_folder


def _root(spark) -> str:
    return f"{shared_folder(spark)}/cw-runs-{uuid.uuid4().hex}"


@query(lessons.WITH + " SELECT s, seq, d_ssim, d_jaccard, d_layout, d_vit, layout_loss, layout_valid FROM sc WHERE seq_b IS NOT NULL")
def SK1_SC6_feature_cache(spark, sf):
    """Signals of all transitions, computed once for these conversations and read from the cache."""
    source, cache = read(spark, sf, "conversations"), FeatureCache(spark, _root(spark))
    frames = lessons.frames(spark, sf)
    cache.put(source, frames.drop("tile"), gr.signals(frames).where("paired"))
    t = cache.get(source)["transitions"]
    return t.select(F.col("session").alias("s"), "seq", "d_ssim", "d_jaccard", "d_layout", "d_vit", "layout_loss", "layout_valid")


def _runs(spark, sf) -> Store:
    """A snapshot an approach, one second apart; the second is deleted again.  The groups are made once for all three."""
    store, found = Store(spark, _root(spark)), checkpointed(gr.summaries(lessons.frames(spark, sf)))
    n = {r["approach"]: r["count"] for r in found.groupBy("approach").count().collect()}  # three rows
    for k, (name, tag) in enumerate((("A1", "frozen baseline"), ("A2", "  "), ("B2", ""))):
        g = found.where(F.col("approach") == name)
        store.save({"groups": g}, tag, {"num_groups": n.get(name, 0)}, {"threshold": "0.35"}, datetime(2024, 1, 1, 0, 0, k))
    store.delete("run_20240101_000001")
    return store


@query(lessons.GROUPED + """ SELECT 'run_20240101_000000' AS snapshot_id, '2024-01-01 00:00:00' AS saved_at, 'frozen baseline' AS tag, (SELECT count(*) FROM (SELECT DISTINCT s, group_a1 FROM gr))::BIGINT AS num_groups
 UNION ALL SELECT 'run_20240101_000002', '2024-01-01 00:00:02', 'Snapshot 20240101_000002', (SELECT count(*) FROM (SELECT DISTINCT s, group_b2 FROM gr))::BIGINT""")
def SK7_SC9_snapshot_listing(spark, sf):
    """What is published after three runs were saved and one was deleted."""
    return _runs(spark, sf).list().select("snapshot_id", "saved_at", "tag", F.col("numbers")["num_groups"].alias("num_groups"))


@query(lessons.GROUPED + ", u AS (" + " UNION ALL ".join(f"SELECT 'run_20240101_00000{i}' AS snapshot_id, '{k.upper()}' AS approach, s, group_{k} AS group_id FROM gr" for i, k in ((0, "a1"), (2, "b2"))) + ") SELECT snapshot_id, approach, s, group_id, count(*)::BIGINT AS frame_count FROM u GROUP BY ALL")
def SC10_loaded_snapshots(spark, sf):
    """The groups of every snapshot that is left, as they were saved."""
    store = _runs(spark, sf)
    ids = [r["snapshot_id"] for r in store.list().select("snapshot_id").collect()]  # a few runs
    parts: list[DataFrame] = [store.load(i, "groups").select(F.lit(i).alias("snapshot_id"), "approach", F.col("session").alias("s"), "group_id", "frame_count") for i in ids]
    return reduce(DataFrame.unionByName, parts)
