"""Readers: images, feature tables, ground truth, file listings; runs are read by ``store``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.sequences import keep_first

IMAGES = "*.{png,jpg,jpeg,PNG,JPG,JPEG}"


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, length, modified of image files (contents are not read)."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).load(folder)
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", F.col("modificationTime").alias("modified"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """filename, height, width, channels, data (BGR bytes); unreadable files are left out."""
    d = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", IMAGES).load(folder).select("image.*")
    return d.select(F.element_at(F.split("origin", "/"), -1).alias("filename"), "height", "width", F.col("nChannels").alias("channels"), "data")


def first_folder(spark: SparkSession, folders: list[str]) -> str | None:
    """The first of the folders that holds an image, or None."""
    for folder in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) and not image_files(spark, folder).isEmpty():
            return folder
    return None


def newest_files(spark: SparkSession, roots: list[str], glob: str = "*.csv") -> DataFrame:
    """Files below the roots, each once, newest first."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    d = reader.load(roots).select("path", "length", F.col("modificationTime").alias("modified"))
    return d.dropDuplicates(["path"]).orderBy(F.desc("modified"), "path")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def transition_truth(raw: DataFrame) -> DataFrame:
    """frame_a, frame_b, label int, note: blank labels go, blank notes become null."""
    d = raw.where(F.trim("label") != "")
    return d.select("frame_a", "frame_b", F.trim("label").try_cast("int").alias("label"), F.nullif(F.trim("researcher_note"), F.lit("")).alias("note"))


def keyframe_truth(raw: DataFrame, order: Column, partition: str | None = None) -> DataFrame:
    """Keyframes with role final or state; blank partitions match any; the last row of a file counts."""
    d = raw.where((F.col("is_keyframe").try_cast("int") == 1) & F.lower("role_type").isin("final", "state"))
    if partition:
        d = d.where(F.coalesce(F.trim("partition_name"), F.lit("")).isin("", partition))
    return keep_first(d, ["frame_filename"], [order.desc()])


def saved_sessions(spark: SparkSession, root: str) -> DataFrame:
    """session, csv, manifest-free json and newest change of every folder ``session_*`` below root, newest first.

    Of several files of a kind the first by name counts; a folder without CSV
    is no saved session.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "session string, csv string, json string, modified timestamp")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,json}").load(root).select("path", "modificationTime")
    parts = F.split("path", "/")
    d = d.select("path", F.element_at(parts, -2).alias("session"), F.element_at(parts, -1).alias("name"), F.col("modificationTime").alias("at")).where(F.startswith("session", F.lit("session_")))
    of = lambda end, ok: F.min_by(F.when(F.endswith("name", F.lit(end)) & ok, F.col("path")), F.when(F.endswith("name", F.lit(end)) & ok, F.col("name")))
    plain = ~F.contains(F.lower("name"), F.lit("manifest"))
    found = d.groupBy("session").agg(of(".csv", F.lit(True)).alias("csv"), of(".json", plain).alias("json"), F.max("at").alias("modified"))
    return found.where("csv is not null").orderBy(F.desc("modified"), "session")
