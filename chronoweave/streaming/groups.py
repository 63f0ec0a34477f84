"""Groups of a session as its frames arrive: one earlier frame and one counter a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "s string, seq long, group_id long, split boolean"


def distance(a: list[str], b: list[str]) -> float:
    """Jaccard distance of token sets, 4 decimals; both empty 0, one empty 1."""
    x, y = set(a), set(b)
    if not x or not y:
        return float(bool(x or y))
    return round(1 - len(x & y) / len(x | y), 4)


def assign(frames: DataFrame, threshold: float = 0.9) -> DataFrame:
    """s, seq, group_id, split of a stream of (s, seq, toks).

    A frame as far as ``threshold`` from the one before it opens a group; the
    first never does.  Frames of a micro-batch are taken by seq; a frame older
    than the last one seen is late and dropped, and so is a repeated one.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, group, toks = state.get if state.exists else (None, 1, [])
        rows = pd.concat(list(parts), ignore_index=True).sort_values("seq", kind="stable")
        out = []
        for seq, now in zip(rows["seq"].tolist(), rows["toks"].tolist()):
            now = [] if now is None else list(now)
            if last is not None and seq <= last:
                continue
            split = last is not None and distance(toks, now) >= threshold
            group += split
            out.append((key[0], seq, group, split))
            last, toks = seq, now
        if last is not None:
            state.update((last, int(group), toks))
        yield pd.DataFrame(out, columns=["s", "seq", "group_id", "split"])

    d = frames.select(F.col("s").cast("string").alias("s"), F.col("seq").cast("long").alias("seq"), "toks").where("seq is not null")
    return d.groupBy("s").applyInPandasWithState(step, OUT, "last long, group long, toks array<string>", "append", GroupStateTimeout.NoTimeout)
