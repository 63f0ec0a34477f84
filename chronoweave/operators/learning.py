"""Scaling and classifiers over Spark ML, with exact quantiles."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.ranks import one_row, quantiles


def robust_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - median) / IQR with exact quartiles; an IQR of 0 counts as 1."""
    q = one_row(quantiles(df, cols, (0.25, 0.5, 0.75)), cols).select(*[F.col(c).alias(f"__q_{c}") for c in cols])
    iqr = lambda c: F.col(f"__q_{c}")[2] - F.col(f"__q_{c}")[0]
    scaled = {c: (F.col(c) - F.col(f"__q_{c}")[1]) / F.when(iqr(c) == 0, 1.0).otherwise(iqr(c)) for c in cols}
    return df.crossJoin(F.broadcast(q)).withColumns(scaled).drop(*[f"__q_{c}" for c in cols])  # q is one row


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""
    m = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__d_{c}") for c in cols])
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__d_{c}") == 0, 1.0).otherwise(F.col(f"__d_{c}")) for c in cols}
    return df.crossJoin(F.broadcast(m)).withColumns(scaled).drop(*m.columns)  # m is one row


def interactions(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds the products of all pairs of different columns, as a*b."""
    return df.withColumns({f"{a}*{b}": F.col(a) * F.col(b) for i, a in enumerate(cols) for b in cols[i + 1 :]})


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    per = n.crossJoin(total).select(F.col(label), (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return df.join(F.broadcast(per), label)  # a row a class: rows are not dealt by so few labels


def fit(df: DataFrame, cols: list[str], label: str, model: str = "logistic", seed: int = 42) -> PipelineModel:
    """logistic (L2), forest (100 trees) or boosted (100 trees of depth 5), classes balanced by weight."""
    where = {"labelCol": label, "weightCol": "weight", "featuresCol": "features"}
    make = {
        "logistic": lambda: LogisticRegression(regParam=0.01, elasticNetParam=0.0, maxIter=100, **where),
        "forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed, **where),
        "boosted": lambda: GBTClassifier(maxIter=100, maxDepth=5, stepSize=0.1, seed=seed, **where),
    }
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), make[model]()]).fit(balanced(df, label))
