"""How long what a frame shows persists: edit distances of token lists to frames before and after."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.batches import parts

#: Tokens of the pairs of lists whose distances a task remembers.
REMEMBERED = 1 << 19


def edit_distance(a: Sequence[str], b: Sequence[str]) -> float:
    """1 - 2 M / (|a| + |b|), where M tokens stand in matching blocks; two empty lists are alike.

    Blocks are found longest first, then left and right of it; in lists of 200
    or more, tokens of ``b`` that make up over a hundredth of it start no block.
    """
    return 1.0 - SequenceMatcher(None, a, b).ratio() if a or b else 0.0


def distances(frames: DataFrame, session: str, seq: str, tokens: str, steps: Sequence[int], between: Sequence[tuple[int, int]] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Session, seq, the columns kept, and the distance to the frame at each step.

    ``d<n>`` is the distance to the frame n places later, ``d_<n>`` that from the
    frame n places before to this one; ``b<n>_<m>`` that from the frame n places
    before to the one m places later, for the pairs in ``between``.  Null where
    there is no such frame.  One window gathers the lists, one Arrow pass
    compares them; equal lists that a task meets one soon after another are
    compared once.
    """
    w = Window.partitionBy(session).orderBy(seq)
    own = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    back = sorted({-n for n in steps if n < 0} | {n for n, _ in between})
    ahead = sorted({n for n in steps if n > 0} | {m for _, m in between})
    d = frames.select(session, seq, *keep, own.alias("__t"))
    d = d.select("*", *[F.lag("__t", n).over(w).alias(f"__b{n}") for n in back], *[F.lead("__t", n).over(w).alias(f"__a{n}") for n in ahead])
    pairs = [(f"d{n}", "__t", f"__a{n}") if n > 0 else (f"d_{-n}", f"__b{-n}", "__t") for n in steps] + [(f"b{n}_{m}", f"__b{n}", f"__a{m}") for n, m in between]
    kept = [session, seq, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float] = {}
        held = 0

        def distance(x, y):
            nonlocal held
            if x is None or y is None:
                return None
            if (x, y) not in known:
                if held > REMEMBERED:
                    known.clear()
                    held = 0
                held += len(x) + len(y)
                known[x, y] = edit_distance(x, y)
            return known[x, y]

        for batch in parts(batches):
            lists = {c: [None if v is None else tuple(v) for v in batch.column(c).to_pylist()] for c in {c for _, *p in pairs for c in p}}
            columns = [pa.array([distance(x, y) for x, y in zip(lists[a], lists[b])], pa.float64()) for _, a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, names=kept + [n for n, *_ in pairs])

    schema = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in kept) + "".join(f", {n} double" for n, *_ in pairs)
    return d.mapInArrow(run, schema)


def chosen_pattern(before: Column, after: Column, across: Column, low: float = 0.05) -> Column:
    """What a wrongly chosen frame was: a flash, the start of something that stays, one step of many, or nothing new."""
    new = before > low
    return F.when((across < low) & new, "transient").when((after < low) & new, "persistent").when(new & (after > low), "evolving").otherwise("continuous")


def truth_pattern(before: Column, after: Column, low: float = 0.05) -> Column:
    """What a rightly chosen frame is: settled, in transition, about to change, or like all around it."""
    return F.when((after < low) & (before > low), "settled").when((after > low) & (before > low), "transition").when((after > low) & (before < low), "pre-transition").otherwise("continuous")
