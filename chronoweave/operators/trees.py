"""Extremely randomised trees, grown level by level from sums over the data.

At every node a few features are drawn and for each a threshold, evenly
between the least and the greatest value the node has; the best of these
splits is taken.  All trees grow together: a level is two passes over the data,
in which each task sends one row a node and candidate, so the driver sees a
table bounded by trees x nodes x candidates and no row of the data.  Draws
follow from (seed, tree, node), never from the partitioning, so the same table
gives the same trees on any cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def draws(seed: int, tree: int, node: int, n: int) -> np.ndarray:
    """n even numbers in [0, 1) that belong to a node."""
    raw = b"".join(hashlib.sha256(f"{seed}:{tree}:{node}:{k}".encode()).digest() for k in range(-(-n // 4)))
    return np.frombuffer(raw, "<u8")[:n] / 2.0**64


@dataclass
class Forest:
    """Trees as heaps: node k has the children 2k and 2k + 1, the root is 1; a node without a feature (-1) is a leaf."""

    features: tuple[str, ...]
    feature: np.ndarray  # (trees, nodes)
    threshold: np.ndarray
    share: np.ndarray  # of label 1 in a node

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the deepest node each row has reached."""
        at = np.ones((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))
        for _ in range(int(math.log2(self.feature.shape[1])) - 1):
            f = self.feature[tree, at]
            if (f < 0).all():  # while the forest grows, its lower levels are empty
                break
            right = np.take_along_axis(x, np.maximum(f, 0), axis=1) > self.threshold[tree, at]
            at = np.where(f >= 0, 2 * at + right, at)
        return at

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The mean share of label 1 in the leaves of each row."""
        return self.share[np.arange(len(self.feature)), self.nodes(x)].mean(axis=1)


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]).astype(np.float64)


def _pass(df: DataFrame, forest: Forest, live: np.ndarray, width: int, make: Callable, how: str) -> np.ndarray:
    """Rows (tree, node, values of ``width``) over all data for the nodes ``live`` (trees, nodes); one Arrow pass and one aggregation."""
    p = len(forest.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch, p), batch.column(p).to_numpy(zero_copy_only=False)
            at = forest.nodes(x)
            held = make(held, x, y, at)
        if held is not None:
            tree, node = np.nonzero(live)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(node), pa.array(list(held[tree, node]), pa.list_(pa.float64()))], names=["tree", "node", "v"])

    agg = {"sum": F.sum, "least": F.min}[how]
    d = df.mapInArrow(run, "tree long, node long, v array<double>")
    rows = d.groupBy("tree", "node").agg(*[agg(F.col("v")[i]).alias(f"v{i}") for i in range(width)]).toArrow()
    out = np.full((*live.shape, width), 0.0 if how == "sum" else np.inf)
    if rows.num_rows:
        out[rows["tree"].to_numpy(), rows["node"].to_numpy()] = np.column_stack([rows[f"v{i}"].to_numpy() for i in range(width)])
    return out


def gini(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Impurity times the number of rows."""
    return 2 * ones * (n - ones) / np.maximum(n, 1)


def fit(df: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 6, candidates: int | None = None, least: int = 2, seed: int = 42) -> Forest:
    """Trees of at most ``depth`` levels of splits; nodes of under ``least`` rows, of one label or of one value are leaves.

    Rows with a null feature or label are left out; an empty table gives
    single leaves of share 0.  ``candidates``: features tried at a node (the
    root of their number).
    """
    p, size = len(features), 1 << (depth + 1)
    k = candidates or max(1, round(math.sqrt(p)))
    d = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y")).dropna()
    forest = Forest(tuple(features), np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size)))
    live = np.zeros((trees, size), bool)
    live[:, 1] = True

    for level in range(depth):

        def ranges(held, x, y, at):
            if held is None:
                held = np.full((trees, size, 2 * p), np.inf)
            both = np.concatenate([x, -x], axis=1)
            for t in range(trees):
                node = at[:, t].astype(np.int16 if size <= 1 << 15 else np.int64)
                order = np.argsort(node, kind="stable")
                node = node[order]
                first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                here = node[first]
                held[t, here] = np.minimum(held[t, here], np.minimum.reduceat(both[order], first, axis=0))
            return held

        ends = _pass(d, forest, live, 2 * p, ranges, "least")
        low, high = ends[..., :p], -ends[..., p:]
        feature, threshold = np.full((trees, size, k), -1), np.zeros((trees, size, k))
        for t, n in zip(*np.nonzero(live)):
            r = draws(seed, int(t), int(n), p + k)
            spread = [f for f in np.argsort(r[:p], kind="stable") if low[t, n, f] < high[t, n, f]][:k]
            for c, f in enumerate(spread):
                feature[t, n, c], threshold[t, n, c] = f, low[t, n, f] + r[p + c] * (high[t, n, f] - low[t, n, f])

        def counts(held, x, y, at):
            if held is None:
                held = np.zeros((trees, size, 2 + 2 * k))
            row = np.arange(len(x))
            for t in range(trees):
                n = at[:, t]
                held[t, :, 0] += np.bincount(n, minlength=size)
                held[t, :, 1] += np.bincount(n, y, size)
                for c in range(k):
                    f = feature[t, n, c]
                    right = (x[row, np.maximum(f, 0)] > threshold[t, n, c]) & (f >= 0)
                    m = n[right]
                    held[t, :, 2 + c] += np.bincount(m, minlength=size)
                    held[t, :, 2 + k + c] += np.bincount(m, y[right], size)
            return held

        sums = _pass(d, forest, live, 2 + 2 * k, counts, "sum")
        n, ones, right, right_ones = sums[..., 0], sums[..., 1], sums[..., 2 : 2 + k], sums[..., 2 + k :]
        forest.share[live] = np.where(n[live] > 0, ones[live] / np.maximum(n[live], 1), 0.0)
        left, left_ones = n[..., None] - right, ones[..., None] - right_ones
        gain = np.where((feature >= 0) & (left > 0) & (right > 0), gini(n, ones)[..., None] - gini(left, left_ones) - gini(right, right_ones), -np.inf)
        best = gain.argmax(axis=2)
        split = live & (n >= max(least, 2)) & (ones > 0) & (ones < n) & (np.take_along_axis(gain, best[..., None], 2)[..., 0] > -np.inf)
        t, node = np.nonzero(split)
        b = best[t, node]
        forest.feature[t, node], forest.threshold[t, node] = feature[t, node, b], threshold[t, node, b]
        live = np.zeros_like(live)
        for child, m, s in ((2 * node, left, left_ones), (2 * node + 1, right, right_ones)):
            live[t, child] = True
            forest.share[t, child] = s[t, node, b] / m[t, node, b]
        if not live.any():
            break
    return forest


def transform(df: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """df with ``probability`` and ``prediction``; null where a feature is null."""
    names = list(forest.features)

    @F.pandas_udf("double")
    def probability(*cols):
        import pandas as pd

        x = np.column_stack([c.to_numpy(float) for c in cols])
        good = ~np.isnan(x).any(axis=1)
        out = np.full(len(x), np.nan)
        out[good] = forest.probability(x[good])
        return pd.Series(out).replace({np.nan: None}).astype("Float64")

    d = df.withColumn("probability", probability(*[F.col(c).cast("double") for c in names]))
    return d.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))


#: The decision threshold of a model in a domain.
THRESHOLDS = [
    ("slides", "logistic", 0.76), ("slides", "forest", 0.60), ("slides", "boosted", 0.60), ("coding", "logistic", 0.76), ("coding", "forest", 0.60), ("coding", "boosted", 0.60),
    ("math", "logistic", 0.50), ("math", "forest", 0.10), ("math", "boosted", 0.10), ("math", "extra", 0.20),
]


def decided(df: DataFrame, domain: str, model: str, score: str, default: float = 0.5) -> DataFrame:
    """df with ``threshold`` (that of the row's domain and model, else the default) and ``decision``."""
    t = df.sparkSession.createDataFrame(THRESHOLDS, "__d string, __m string, threshold double")
    j = df.join(F.broadcast(t), (F.col(domain) == F.col("__d")) & (F.col(model) == F.col("__m")), "left").drop("__d", "__m")  # ten rows are broadcast
    return j.withColumn("threshold", F.coalesce("threshold", F.lit(default))).withColumn("decision", (F.col(score) >= F.col("threshold")).cast("int"))
