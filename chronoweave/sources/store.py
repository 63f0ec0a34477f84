"""A store of snapshots: tables written aside, then published by one small file.

``<root>/_staging/<random>`` holds what is being written, ``<root>/data/<id>``
the tables of a snapshot, ``<root>/manifests/<id>.json`` what is published.  A
snapshot exists if its manifest does, and the manifest is the last file to
come and the first to go: a run that is cut off anywhere leaves nothing that a
reader sees.  Snapshots are immutable: a second one of the same id is refused.
All paths go through Hadoop's file systems, so any store that Spark can reach
will do.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "snapshot_id string, saved_at string, tag string, tables map<string, bigint>, fingerprints map<string, string>, numbers map<string, bigint>, config map<string, string>"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on one machine a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="chronoweave-")
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """The table as it is now, kept in the folder that all executors share; what reads it twice sees the same rows."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows of a table and a hash of its contents that does not depend on their order."""
    parts = F.xxhash64(*df.columns) if df.columns else F.lit(0).cast("long")
    r = df.select(parts.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return r["n"], f"{r['s'] or 0}:{r['x'] or 0}"


class Store:
    """Snapshots below one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.Path("/".join([self.root, *parts]))

    def _publish(self, snapshot_id: str, manifest: dict) -> None:
        """A manifest is whole or not there: it gets its name when it is written."""
        aside, at = self._path("_staging", uuid.uuid4().hex), self._path("manifests", f"{snapshot_id}.json")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        self._fs.mkdirs(at.getParent())
        if self._fs.exists(at) or not self._fs.rename(aside, at):
            self._fs.delete(aside, True)
            raise FileExistsError(f"snapshot {snapshot_id} exists; snapshots are immutable")

    def save(self, tables: Mapping[str, DataFrame], tag: str = "", numbers: Mapping[str, int] | None = None, config: Mapping[str, str] | None = None, now: datetime | None = None, snapshot_id: str | None = None) -> str:
        """Writes and publishes a snapshot, returns its id; a blank tag gets a default."""
        now = now or datetime.now()
        stamp = f"{now:%Y%m%d_%H%M%S}"
        snapshot_id = snapshot_id or f"run_{stamp}"
        if self._fs.exists(self._path("manifests", f"{snapshot_id}.json")):
            raise FileExistsError(f"snapshot {snapshot_id} exists; snapshots are immutable")
        aside = uuid.uuid4().hex
        marks = {}
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/_staging/{aside}/{name}")
            marks[name] = fingerprint(self.spark.read.schema(df.schema).parquet(f"{self.root}/_staging/{aside}/{name}"))
        at = self._path("data", snapshot_id)
        self._fs.mkdirs(at.getParent())
        self._fs.delete(at, True)  # what a run that was cut off left under this id was never published
        if tables and not self._fs.rename(self._path("_staging", aside), at):
            raise OSError(f"cannot move the tables of {snapshot_id} to their place")
        manifest = {
            "snapshot_id": snapshot_id, "saved_at": f"{now:%Y-%m-%d %H:%M:%S}", "tag": tag.strip() or f"Snapshot {stamp}", "tables": {n: m[0] for n, m in marks.items()},
            "fingerprints": {n: m[1] for n, m in marks.items()}, "numbers": dict(numbers or {}), "config": dict(config or {}),
        }
        self._publish(snapshot_id, manifest)
        return snapshot_id

    def list(self) -> DataFrame:
        """The manifests, newest first; corrupt ones are skipped, missing fields get defaults."""
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return self.spark.createDataFrame([], MANIFEST)
        d = self.spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(f"{self.root}/manifests")
        none = lambda c: F.coalesce(c, F.create_map().cast(d.schema[c].dataType)).alias(c)
        d = d.where("snapshot_id is not null")
        return d.select("snapshot_id", F.coalesce("saved_at", F.lit("Unknown")).alias("saved_at"), F.coalesce("tag", F.lit("Unnamed Run")).alias("tag"), *[none(c) for c in ("tables", "fingerprints", "numbers", "config")]).orderBy(F.desc("saved_at"), F.desc("snapshot_id"))

    def load(self, snapshot_id: str, table: str) -> DataFrame | None:
        """A table of a published snapshot; None if there is none or its files cannot be read."""
        row = self.list().where(F.col("snapshot_id") == snapshot_id).select("tables").first()
        if row is None or table not in row["tables"]:
            return None
        try:
            return self.spark.read.parquet(f"{self.root}/data/{snapshot_id}/{table}")
        except PySparkException:
            return None

    def intact(self, snapshot_id: str) -> bool:
        """Whether all tables still have the contents that were published."""
        row = self.list().where(F.col("snapshot_id") == snapshot_id).first()
        if row is None:
            return False
        for name, rows in row["tables"].items():
            df = self.load(snapshot_id, name)
            if df is None or fingerprint(df) != (rows, row["fingerprints"][name]):
                return False
        return True

    def delete(self, snapshot_id: str) -> bool:
        """Takes a snapshot back: first its manifest, then its tables; False if there is none."""
        at = self._path("manifests", f"{snapshot_id}.json")
        if not self._fs.exists(at) or not self._fs.delete(at, False):
            return False
        self._fs.delete(self._path("data", snapshot_id), True)
        return True

    def sweep(self) -> int:
        """Removes tables without a manifest and what was staged; only for a time without writers."""
        published = {r["snapshot_id"] for r in self.list().select("snapshot_id").collect()}
        gone = 0
        for part in ("_staging", "data"):
            at = self._path(part)
            for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if part == "_staging" or s.getPath().getName() not in published:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone


#: The columns of the flat table of transitions, in order.
FLAT = (
    "pair_idx", "frame_a", "frame_b", "original_frame_id_a", "original_frame_id_b", "timestamp_a", "timestamp_b", "delta_time_sec", "token_count_a", "token_count_b", "token_count_diff", "d_ssim", "d_ocr_jaccard",
    "ocr_preservation", "ocr_loss", "ocr_valid_raw", "d_layout_iou", "layout_preservation", "layout_loss", "layout_valid", "d_vit_cosine",
)


class FeatureCache:
    """Frames and transitions of a session's run, kept under the fingerprint of what they were made from."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.store = Store(spark, root)

    def key(self, source: DataFrame) -> str:
        rows, mark = fingerprint(source)
        return f"features_{rows}_{mark.replace(':', '_').replace('-', 'm')}"

    def put(self, source: DataFrame, frames: DataFrame, transitions: DataFrame, **more: DataFrame) -> str:
        """Keeps the tables of a source; a source that is kept already stays as it is."""
        key = self.key(source)
        if self.get(source) is None:
            self.store.delete(key)  # published, but no longer readable
            self.store.save({"frames": frames, "transitions": transitions, **more}, "feature cache", snapshot_id=key)
        return key

    def get(self, source: DataFrame) -> dict[str, DataFrame] | None:
        """The tables kept for exactly these contents, or None."""
        key = self.key(source)
        row = self.store.list().where(F.col("snapshot_id") == key).select("tables").first()
        if row is None:
            return None
        found = {name: self.store.load(key, name) for name in row["tables"]}
        return None if any(v is None for v in found.values()) else found


def flat(transitions: DataFrame, path: str) -> None:
    """The transitions as CSV with a header: the columns of FLAT in order, null where one is missing, null as the empty field."""
    there = set(transitions.columns)
    transitions.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in there else F.lit("").alias(c) for c in FLAT]).write.csv(path, header=True, emptyValue="")
