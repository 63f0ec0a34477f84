"""Writers: versioned datasets, labels and routed frames; runs are kept by ``store``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def versioned(df: DataFrame, path: str) -> str:
    """Writes CSV to path, or to path_v1, path_v2, ... if that exists; returns where."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    k, at = 0, path
    while True:
        p = spark._jvm.org.apache.hadoop.fs.Path(at)
        if not p.getFileSystem(conf).exists(p):
            break
        k += 1
        at = f"{path}_v{k}"
    df.write.mode("errorifexists").csv(at, header=True)
    return at


def labels(df: DataFrame, path: str) -> None:
    """CSV with nulls as empty fields."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True, emptyValue="")


def keyframes(df: DataFrame, path: str) -> None:
    """Sorted by group, time and file."""
    labels(df.orderBy("group_id", "timestamp_sec", "frame_filename"), path)


def routed(df: DataFrame, root: str, by: str = "prediction") -> None:
    """Frames below one folder a prediction."""
    df.write.mode("overwrite").partitionBy(by).parquet(root)
