"""Reading order of text blocks on a page: paragraphs, bands, columns, lines.

A page is the unit of work; pages of a batch are gathered by Spark and read in
one Arrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["block", "x1", "y1", "x2", "y2", "font"]
OUT = "block long, paragraph_id long, band string, column_id long, line_id long, position long"


def _common(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Overlap of two intervals as a share of the shorter; 0 if they do not overlap."""
    short, both = min(a[1] - a[0], b[1] - b[0]), min(a[1], b[1]) - max(a[0], b[0])
    return both / short if both > 0 and short > 0 else 0.0


def _middle(b: dict, axis: str) -> float:
    return (b[f"{axis}1"] + b[f"{axis}2"]) / 2


@dataclass
class Paragraph:
    """Blocks that stand below one another, with the hull around them and the lowest one."""

    blocks: list[dict] = field(default_factory=list)
    x: tuple[float, float] = (float("inf"), float("-inf"))
    y: tuple[float, float] = (float("inf"), float("-inf"))

    def add(self, b: dict) -> None:
        self.blocks.append(b)
        self.x = min(self.x[0], b["x1"]), max(self.x[1], b["x2"])
        self.y = min(self.y[0], b["y1"]), max(self.y[1], b["y2"])

    @property
    def last(self) -> dict:
        """The block whose middle is lowest; of several the one that came last."""
        return max(enumerate(self.blocks), key=lambda kb: (_middle(kb[1], "y"), kb[0]))[1]

    def takes(self, b: dict, overlap: float, font_step: float) -> bool:
        """Whether a block stands under this paragraph, close to its last block and of a like font."""
        end = self.last
        near = b["y1"] - end["y2"] <= max(10, 0.5 * max(b["font"], end["font"]))
        return _common((b["x1"], b["x2"]), self.x) > overlap and near and abs(b["font"] - end["font"]) <= font_step


def paragraphs(blocks: Sequence[dict], overlap: float = 0.4, font_step: float = 6) -> list[Paragraph]:
    """Each block, by its middle from the top, joins the first paragraph that takes it."""
    out: list[Paragraph] = []
    for b in sorted(blocks, key=lambda b: (_middle(b, "y"), _middle(b, "x"), b["block"])):
        home = next((p for p in out if p.takes(b, overlap, font_step)), None)
        if home is None:
            out.append(home := Paragraph())
        home.add(b)
    return out


def bands(pars: Sequence[Paragraph], beside: float = 0.15) -> list[tuple[str, list[Paragraph]]]:
    """Rows of one paragraph that has none beside it, and between rows all others together."""
    out: list[tuple[str, list[Paragraph]]] = []
    for p in sorted(pars, key=lambda p: p.y[0]):
        alone = not any(q is not p and _common(p.y, q.y) > beside for q in pars)
        if alone:
            out.append(("row", [p]))
        elif out and out[-1][0] == "column":
            out[-1][1].append(p)
        else:
            out.append(("column", [p]))
    return out


def columns(band: Sequence[Paragraph], overlap: float = 0.4, near: float = 120) -> list[list[Paragraph]]:
    """Paragraphs from the left join the first column that they overlap or whose centre is near; columns go by their mean centre."""
    out: list[list[Paragraph]] = []
    hull = lambda c: (min(p.x[0] for p in c), max(p.x[1] for p in c))
    for p in sorted(band, key=lambda p: p.x[0]):
        home = next((c for c in out if _common(p.x, hull(c)) > overlap or abs(sum(p.x) - sum(hull(c))) / 2 < near), None)
        if home is None:
            out.append(home := [])
        home.append(p)
    centre = lambda c: sum(sum(_middle(b, "x") for b in p.blocks) / len(p.blocks) for p in c) / len(c)
    return [sorted(c, key=lambda p: p.y[0]) for c in sorted(out, key=centre)]


def lines(p: Paragraph, tolerance: float) -> list[list[dict]]:
    """Blocks of about one height form a line, read from left to right."""
    out: list[list[dict]] = []
    height = lambda line: sum(_middle(b, "y") for b in line) / len(line)
    for b in sorted(p.blocks, key=lambda b: _middle(b, "y")):
        home = next((line for line in out if abs(_middle(b, "y") - height(line)) <= tolerance), None)
        if home is None:
            out.append(home := [])
        home.append(b)
    return [sorted(line, key=lambda b: _middle(b, "x")) for line in sorted(out, key=height)]


def order(blocks: Sequence[dict], tolerance: float = 15) -> list[tuple]:
    """(block, paragraph, band, column or None, line, position) in reading order.

    Paragraphs, lines and positions are counted from 1 over the page, columns
    from 1 in each band.
    """
    out, paragraph, line = [], 0, 0
    for kind, band in bands(paragraphs(blocks)):
        for k, column in enumerate(columns(band) if kind == "column" else [band], 1):
            for p in column:
                paragraph += 1
                for row in lines(p, tolerance):
                    line += 1
                    for b in row:
                        out.append((b["block"], paragraph, kind, k if kind == "column" else None, line, len(out) + 1))
    return out


def analyse(df: DataFrame, page: str, tolerance: float = 15) -> DataFrame:
    """Reading order of every page of (page, block, x1, y1, x2, y2, font); blocks with a null go."""
    kind = df.schema[page].dataType.simpleString()
    d = df.select(F.col(page).alias("page"), F.col("block").cast("long").alias("block"), *[F.col(c).cast("double").alias(c) for c in COLUMNS[1:]]).dropna()
    d = d.groupBy("page").agg(F.collect_list(F.struct(*COLUMNS)).alias("blocks"))
    names = ["page", "block", "paragraph_id", "band", "column_id", "line_id", "position"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, blocks in enumerate(batch.column(1).to_pylist()):
                found = order(blocks, tolerance)
                rows += found
                index += [i] * len(found)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), *[pa.array(v, t) for v, t in zip(zip(*rows), types)]], names=names)

    return d.mapInArrow(run, f"page {kind}, {OUT}")
