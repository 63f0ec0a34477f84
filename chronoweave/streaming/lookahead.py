"""Splits of a stream that need the frame after and the three before: answers come one frame late.

The state of a session holds frames that are not old enough to be sure of their
order, the last answered frames that later ones look back at, and the group's
number.  The watermark decides: frames at or before it are final and are taken
in order of time; the others wait, with a timer set at the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.streaming.groups import distance

OUT = "s string, ts timestamp, split boolean, popup boolean, reset boolean, group_id long"
_STATE = "waiting array<struct<at:long,toks:array<string>,boxes:long>>, answered array<struct<at:long,toks:array<string>,boxes:long>>, last long, group long"


def _judge(before: list[tuple], frame: tuple, after: tuple | None, threshold: float, more: int, overlap: float) -> tuple[bool, bool, bool]:
    """split, popup and reset of a frame, from up to three frames before it and the one after."""
    toks = set(frame[1])
    counts = [f[2] for f in before[-3:]]
    reset = frame[2] <= 1 and bool(counts) and max(counts) >= 4
    split = after is not None and distance(frame[1], after[1]) >= threshold
    popup = False
    if after is not None and before:
        p, n = set(before[-1][1]), set(after[1])
        popup = len(toks) > len(p) + more and len(toks) > len(n) + more and len(p) > 0 and len(p & n) / len(p) >= overlap
    return split and not popup, popup, reset


def answers(frames: DataFrame, late: str = "10 seconds", threshold: float = 0.9, more: int = 8, overlap: float = 0.5, idle: str = "1 hour") -> DataFrame:
    """Of a stream of (s, ts, toks, boxes): whether the next frame opens a group, a pop-up, a cleared canvas, the group.

    A frame is answered when the next one of its session is final, or when
    none has come for ``idle`` of event time (then it does not split).  Frames
    older than the last answered one are late and dropped, as are repeated ones.
    """
    gap = pd.Timedelta(idle).value // 1000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, answered, last, group = state.get if state.exists else ([], [], -(1 << 62), 1)
        held = {int(f[0]): (int(f[0]), list(f[1]), int(f[2])) for f in waiting}
        if not state.hasTimedOut:
            for part in parts:
                for at, toks, boxes in zip(part["at"].tolist(), part["toks"].tolist(), part["boxes"].tolist()):
                    if at > last and at not in held:
                        held[at] = (at, [] if toks is None else list(toks), 0 if boxes is None or boxes != boxes else int(boxes))
        mark = state.getCurrentWatermarkMs() * 1000  # microseconds, as ``at``
        before = [(int(f[0]), list(f[1]), int(f[2])) for f in answered]
        line, out = sorted(held.values()), []
        final = [f for f in line if f[0] <= mark]
        done = 0
        for i, f in enumerate(final):
            after = final[i + 1] if i + 1 < len(final) else None
            if after is None and (i + 1 < len(line) or mark - f[0] < gap):
                break
            split, popup, reset = _judge(before, f, after, threshold, more, overlap)
            out.append((key[0], pd.Timestamp(f[0], unit="us"), split, popup, reset, int(group)))
            group += split
            last, before, done = f[0], [*before, f][-3:], i + 1
        rest = line[done:]
        if rest or before:
            state.update((rest, before, int(last), int(group)))
        if rest:
            # The first frame that waits is final once the watermark has passed the one behind it, or after the idle time.
            wake = (rest[1][0] if len(rest) > 1 else rest[0][0] + gap) // 1000 + 1
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["s", "ts", "split", "popup", "reset", "group_id"])

    d = frames.select(F.col("s").cast("string").alias("s"), F.col("ts").cast("timestamp").alias("ts"), "toks", F.col("boxes").cast("long").alias("boxes")).where("ts is not null").withWatermark("ts", late)
    d = d.withColumn("at", F.unix_micros("ts"))
    return d.groupBy("s").applyInPandasWithState(step, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def batch(frames: DataFrame, threshold: float = 0.9, more: int = 8, overlap: float = 0.5) -> DataFrame:
    """The same answers over a whole table, by windows; of frames of one time the first by content counts."""
    none = F.array().cast("array<string>")
    d = frames.select(F.col("s").cast("string").alias("s"), F.col("ts").cast("timestamp").alias("ts"), F.array_distinct(F.coalesce("toks", none)).alias("toks"), F.coalesce(F.col("boxes").cast("long"), F.lit(0)).alias("boxes")).where("ts is not null")
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy("s", "ts").orderBy("toks", "boxes"))).where("__r = 1")
    w = Window.partitionBy("s").orderBy("ts")
    before, after, size = F.lag("toks").over(w), F.lead("toks").over(w), F.size("toks")
    d = d.select("s", "ts", "toks", "boxes", before.alias("p"), after.alias("n"), F.max("boxes").over(w.rowsBetween(-3, -1)).alias("recent"))
    agree = F.size(F.array_intersect("p", "n")) / F.size("p")
    popup = F.coalesce((size > F.size("p") + more) & (size > F.size("n") + more) & (F.size("p") > 0) & (agree >= overlap), F.lit(False))
    either = F.size(F.array_union("toks", "n"))
    far = F.when((size == 0) | (F.size("n") == 0), F.when(either > 0, 1.0).otherwise(0.0)).otherwise(F.round(1 - F.size(F.array_intersect("toks", "n")) / either, 4))
    d = d.select("s", "ts", (F.col("n").isNotNull() & (far >= threshold) & ~popup).alias("split"), popup.alias("popup"), F.coalesce((F.col("boxes") <= 1) & (F.col("recent") >= 4), F.lit(False)).alias("reset"))
    return d.withColumn("group_id", (1 + F.coalesce(F.sum(F.col("split").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long"))
