"""Layout of boxes on a page: masks, overlaps and occupied cells.

Boxes are [x1, y1, x2, y2] in [0, 1].
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def mask(boxes: list, side: int = 256) -> np.ndarray:
    """A side x side raster of the boxes; vertices are clipped to the page."""
    out = np.zeros((side, side), bool)
    for x1, y1, x2, y2 in boxes or []:
        a, b, c, d = (int(min(max(v, 0.0), 1.0) * side) for v in (x1, y1, x2, y2))
        out[b : min(d, side - 1) + 1, a : min(c, side - 1) + 1] = True
    return out


def overlap(a: list, b: list, side: int = 256) -> dict:
    """iou, preservation and loss of a's area, and whether they are valid."""
    if not a or not b:
        both = not a and not b
        share = 1.0 if both else 0.0
        return {"iou": share, "preservation": share, "loss": 1 - share, "valid": both or bool(a)}
    x, y = mask(a, side), mask(b, side)
    common, either, area = int((x & y).sum()), int((x | y).sum()), int(x.sum())
    kept = common / area if area else 0.0
    return {"iou": round(common / either, 4) if either else 1.0, "preservation": round(kept, 4), "loss": round(1 - kept, 4), "valid": area > 0}


def cells(box: Column, side: int = 16) -> Column:
    """Cells gx * side + gy that a box touches, both ends inclusive."""
    at = lambda k: F.least(F.lit(side - 1), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), box[k])) * side)).cast("int")
    xs, ys = F.sequence(at(0), at(2)), F.sequence(at(1), at(3))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: x * side + y)))
