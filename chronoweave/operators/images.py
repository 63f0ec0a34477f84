"""Image features in one Arrow pass: preprocessing, histograms, edges, similarity maps and text masks.

Kernels work on a stack of images (n, height, width) at once; an image column
is a struct <height, width, pixels> with one gray value or three colours a
pixel (binary or an array of numbers).  Images of one batch are stacked by
size.  Nothing is shuffled: a task works on a part of an Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweave.operators import pixels as px
from chronoweave.operators.batches import parts

#: Pairs of pictures that are stacked at once: histograms of all cells are hundreds of times a small picture.
STACK = 64
#: Kernels of small blurs, in 256ths, and the tangent of 22.5 degrees in 2^-15.
BLURS = {3: (64, 128, 64), 5: (16, 64, 96, 64, 16), 7: (8, 28, 56, 72, 56, 28, 8)}
TANGENT = 13573


@dataclass(frozen=True)
class Config:
    """Parameters of the extractors; the defaults are fixed values."""

    bins: int = 64
    grid: int = 4
    epsilon: float = 1e-10
    blur: int = 5
    low: int = 50
    high: int = 150
    window: int = 11
    gaussian: bool = True
    threshold: int = 127
    kernel: int = 5
    iterations: int = 2
    min_area: int = 100


def gaussian(size: int, sigma: float | None = None) -> np.ndarray:
    """Weights of a Gaussian window, summing to 1."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def separable(stack: np.ndarray, weights: np.ndarray, border: str) -> np.ndarray:
    """Rows, then columns, convolved with a symmetric window; ``border`` is a mode of numpy's pad."""
    out, r = stack.astype(np.float64), len(weights) // 2
    for axis in (2, 1):
        wide = np.pad(out, [(0, 0) if a != axis else (r, r) for a in range(3)], border)
        size = out.shape[axis]
        out = sum(w * np.take(wide, range(k, k + size), axis) for k, w in enumerate(weights))
    return out


def blur(stack: np.ndarray, size: int) -> np.ndarray:
    """Gaussian blur of bytes, borders mirrored without the edge."""
    if size in BLURS:
        whole = separable(stack, np.array(BLURS[size], np.float64), "reflect").astype(np.int64)
        return ((whole + (1 << 15)) >> 16).astype(np.uint8)
    return np.rint(separable(stack, gaussian(size), "reflect")).astype(np.uint8)


def adaptive(stack: np.ndarray, size: int = 11, less: int = 2) -> np.ndarray:
    """255 where a pixel is over its Gaussian neighbourhood's mean minus ``less``, else 0; borders repeat the edge."""
    mean = np.rint(separable(stack, gaussian(size), "edge"))
    return np.where(stack > mean - less, 255, 0).astype(np.uint8)


def preprocess(stack: np.ndarray, mode: str, blurred: int = 0) -> np.ndarray:
    """Gray images after a mode: ``gray``, ``adaptive`` or ``none`` (as they are), each with an optional blur first."""
    if mode not in ("gray", "adaptive", "none"):
        raise ValueError(f"unknown mode {mode}")
    out = blur(stack, blurred) if blurred else stack
    return adaptive(out) if mode == "adaptive" else out


def cells(height: int, width: int, grid: int) -> np.ndarray:
    """The cell of every pixel; a side of h pixels is cut at int(i * h / grid)."""
    at = lambda n: np.repeat(np.arange(grid), np.diff([int(i * (n / grid)) for i in range(grid)] + [n]))
    return at(height)[:, None] * grid + at(width)


def histograms(planes: np.ndarray, bins: int, eps: float, cell: np.ndarray | None = None, n_cells: int = 1) -> np.ndarray:
    """(images, cells, bins of all colours): every pixel is counted once, whatever the grid.

    ``planes`` is (images, colours, height, width); each cell sums to 1, cells without a pixel are even.
    """
    n, colours = planes.shape[:2]
    cell = np.zeros(planes.shape[2:], np.int64) if cell is None else cell
    place = (np.arange(n)[:, None, None, None] * n_cells + cell) * colours + np.arange(colours)[:, None, None]
    h = np.bincount((place * bins + planes.astype(np.int64) * bins // 256).ravel(), minlength=n * n_cells * colours * bins).reshape(n, n_cells, colours * bins) + eps
    return h / h.sum(axis=2, keepdims=True)


def compare(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Correlation, intersection, Bhattacharyya distance and chi-square along the last axis."""
    x, y = a - a.mean(-1, keepdims=True), b - b.mean(-1, keepdims=True)
    spread = np.sqrt((x * x).sum(-1) * (y * y).sum(-1))
    some = np.abs(a) > np.finfo(float).eps
    return {
        "correlation": np.where(spread > 0, (x * y).sum(-1) / np.where(spread > 0, spread, 1), 1.0),
        "intersection": np.minimum(a, b).sum(-1),
        "bhattacharyya": np.sqrt(np.maximum(0, 1 - np.sqrt(a * b).sum(-1) / np.sqrt(a.sum(-1) * b.sum(-1)))),
        "chisquare": np.where(some, (a - b) ** 2 / np.where(some, a, 1), 0).sum(-1),
    }


def spread(values: np.ndarray) -> dict[str, np.ndarray]:
    """mean, max, min, var and std (of the whole population) along the last axis."""
    return {"mean": values.mean(-1), "max": values.max(-1), "min": values.min(-1), "var": values.var(-1), "std": values.std(-1)}


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for links a-b of n nodes."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


class Components:
    """8-connected components of a stack of masks, by runs of pixels.

    First pass: maximal runs of every row.  Second pass: runs of neighbouring
    rows that touch are joined, all images at once.
    """

    def __init__(self, mask: np.ndarray) -> None:
        n, h, w = mask.shape
        self.shape = mask.shape
        wide = np.zeros((n * (h + 1), w + 1), np.int8)  # an empty row and column keep runs apart
        wide.reshape(n, h + 1, w + 1)[:, :h, :w] = mask
        step = np.diff(wide.ravel(), prepend=0)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)  # end is past the last
        below = self.start + (w + 1)
        first = np.searchsorted(self.end, below, "left")  # touches diagonally: end >= start
        last = np.searchsorted(self.start, self.end + (w + 1), "right")  # start <= end
        count = np.maximum(last - first, 0)
        a = np.repeat(np.arange(len(self.start)), count)
        b = first[a] + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        self.label = joined(a, b, len(self.start))
        self.size = np.bincount(self.label, self.end - self.start, len(self.start)).astype(np.int64)

    def keep(self, runs: np.ndarray) -> np.ndarray:
        """The mask of the runs chosen."""
        n, h, w = self.shape
        step = np.zeros(n * (h + 1) * (w + 1) + 1, np.int8)
        step[self.start[runs]] += 1
        step[self.end[runs]] -= 1
        return np.cumsum(step, dtype=np.int8)[:-1].reshape(n, h + 1, w + 1)[:, :h, :w].astype(bool)


def dilate(mask: np.ndarray, kernel: int, iterations: int) -> np.ndarray:
    """Rectangle dilation, ``iterations`` times: one wider window, by counts along rows, then columns."""
    back, ahead = (kernel // 2) * iterations, (kernel - 1 - kernel // 2) * iterations
    for axis in (2, 1):
        size = mask.shape[axis]
        total = np.concatenate([np.zeros_like(np.take(mask, [0], axis), dtype=np.int64), np.cumsum(mask, axis, dtype=np.int64)], axis)
        hi, lo = np.minimum(np.arange(size) + ahead + 1, size), np.maximum(np.arange(size) - back, 0)
        mask = np.take(total, hi, axis) > np.take(total, lo, axis)
    return mask


def text_mask(gray: np.ndarray, threshold: int = 127, kernel: int = 5, iterations: int = 2, min_area: int = 100) -> np.ndarray:
    """Pixels of text: bright on a dark picture (mean under 127), dark on a light one; dilated, small components dropped."""
    dark = gray.mean(axis=(1, 2)) < 127
    bright = gray > (255 - threshold if threshold < 128 else threshold)
    mask = dilate(np.where(dark[:, None, None], bright, gray <= threshold), kernel, iterations)
    c = Components(mask)
    return c.keep(c.size[c.label] >= min_area)


def canny(gray: np.ndarray, low: int = 50, high: int = 150, blurred: int = 0) -> np.ndarray:
    """Canny edges: 3 x 3 Sobel gradients of size |dx| + |dy|, thinned across four directions, then grown from strong ones."""
    g = np.pad((blur(gray, blurred) if blurred else gray).astype(np.int64), ((0, 0), (1, 1), (1, 1)), "edge")
    row = lambda y: g[:, y : g.shape[1] - 2 + y]
    col = lambda v, x: v[:, :, x : g.shape[2] - 2 + x]
    across, down = row(0) + 2 * row(1) + row(2), row(2) - row(0)
    dx, dy = col(across, 2) - col(across, 0), col(down, 0) + 2 * col(down, 1) + col(down, 2)
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, ((0, 0), (1, 1), (1, 1)))
    at = lambda y, x: m[:, 1 + y : m.shape[1] - 1 + y, 1 + x : m.shape[2] - 1 + x]
    ax, ay = np.abs(dx) * TANGENT, np.abs(dy) << 15
    flat, steep, falling = ay < ax, ay > ax + (np.abs(dx) << 16), (dx ^ dy) < 0
    top = np.where(
        flat, (size > at(0, -1)) & (size >= at(0, 1)),
        np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(falling, (size > at(-1, 1)) & (size > at(1, -1)), (size > at(-1, -1)) & (size > at(1, 1)))),
    )
    weak = top & (size > low)
    c = Components(weak)
    strong = np.zeros(gray.shape[0] * (gray.shape[1] + 1) * (gray.shape[2] + 1), np.int64)
    strong.reshape(gray.shape[0], gray.shape[1] + 1, -1)[:, :-1, :-1] = weak & (size > high)
    total = np.concatenate([[0], np.cumsum(strong)])
    grown = np.bincount(c.label, total[c.end] - total[c.start], len(c.start)) > 0
    return c.keep(grown[c.label])


def densities(mask: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of set pixels of each image and of each of its cells that have pixels."""
    n, h, w = mask.shape
    cell = cells(h, w, grid)
    size = np.bincount(cell.ravel(), minlength=grid * grid)
    set_ = np.bincount((np.arange(n)[:, None, None] * grid * grid + cell)[mask], minlength=n * grid * grid).reshape(n, -1)
    return mask.mean(axis=(1, 2)), set_[:, size > 0] / size[size > 0]


def ssim_map(a: np.ndarray, b: np.ndarray, window: int = 11, weighted: bool = True, span: float = 255.0) -> tuple[np.ndarray, np.ndarray]:
    """The map of structural similarities of stacks and its mean away from the borders.

    The window shrinks to the image (odd, 3 at least).  Weighted: a Gaussian of
    sigma 1.5 over eleven pixels; else an even window.  Borders are mirrored
    with the edge; covariances are those of a sample of window squared pixels.
    """
    least = min(a.shape[1:])
    window = window if least >= window else max(3, least - 1 + least % 2)
    if least < window:
        raise ValueError("images under 3 x 3 have no window")
    mean = partial(separable, weights=gaussian(11, 1.5) if weighted else np.full(window, 1 / window), border="symmetric")
    x, y = a.astype(np.float64), b.astype(np.float64)
    mx, my, k = mean(x), mean(y), window**2 / (window**2 - 1)
    vx, vy, vxy = k * (mean(x * x) - mx * mx), k * (mean(y * y) - my * my), k * (mean(x * y) - mx * my)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    s = ((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))
    r = (window - 1) // 2
    return s, s[:, r : s.shape[1] - r, r : s.shape[2] - r].mean(axis=(1, 2))


def gray_of(planes: np.ndarray) -> np.ndarray:
    """Gray values of (images, colours, height, width)."""
    if planes.shape[1] == 1:
        return planes[:, 0]
    return np.stack([px.gray(np.moveaxis(p, 0, -1)) for p in planes])


def _three(planes: np.ndarray) -> np.ndarray:
    return np.repeat(planes, 3, axis=1) if planes.shape[1] == 1 else planes


def histogram_extractor(a: np.ndarray, b: np.ndarray, c: Config) -> dict[str, np.ndarray]:
    """Brightness, contrast, entropy, statistics of histograms of either image, and their comparisons, whole and by cell."""
    out: dict[str, np.ndarray] = {}
    grid = cells(*a.shape[2:], c.grid)
    here = np.bincount(grid.ravel(), minlength=c.grid**2) > 0
    held = {}
    for side, planes in (("a", a), ("b", b)):
        g = gray_of(planes)
        p = histograms(g[:, None], 256, 0.0)[:, 0]
        out |= {f"{side}_brightness": g.mean(axis=(1, 2)), f"{side}_contrast": g.std(axis=(1, 2)), f"{side}_entropy": -(p * np.log2(p + 1e-7)).sum(-1)}
        for name, v in (("rgb", _three(planes)), ("gray", g[:, None])):
            held[side, name] = h = histograms(v, c.bins, c.epsilon)[:, 0], histograms(v, c.bins, c.epsilon, grid, c.grid**2)[:, here]
            out |= {f"{side}_global_{name}_hist_{k}": x for k, x in spread(h[0]).items()}
            out |= {f"{side}_grid_{name}_hist_{k}": x.mean(-1) for k, x in spread(h[1]).items()}
    for name in ("rgb", "gray"):
        (wa, ca), (wb, cb) = held["a", name], held["b", name]
        out |= {f"{name}_hist_dist_global_{k}": x for k, x in compare(wa, wb).items()}
        out |= {f"{name}_hist_grid_{s}_{k}": y for k, x in compare(ca, cb).items() for s, y in spread(x).items()}
    return out


def edge_extractor(a: np.ndarray, b: np.ndarray, c: Config) -> dict[str, np.ndarray]:
    """Edge densities of either image, whole and by cell, and their differences."""
    (da, ga), (db, gb) = (densities(canny(gray_of(p), c.low, c.high, c.blur), c.grid) for p in (a, b))
    out = {"a_edge_density": da, "b_edge_density": db, "whole_edge_density_diff": np.abs(da - db)}
    out |= {f"{side}_grid_edge_{k}": x for side, g in (("a", ga), ("b", gb)) for k, x in spread(g).items()}
    return out | {f"grid_edge_{k}_diff": x for k, x in spread(np.abs(ga - gb)).items()}


def ssim_extractor(a: np.ndarray, b: np.ndarray, c: Config) -> dict[str, np.ndarray]:
    """Mean, least and variance of the similarity map, and the mean absolute difference of the pixels."""
    s, mean = ssim_map(gray_of(a), gray_of(b), c.window, c.gaussian)
    flat = s.reshape(len(s), -1)
    return {"ssim_mean": mean, "ssim_min": flat.min(-1), "ssim_variance": flat.var(-1), "mean_absolute_difference": np.abs(a.astype(np.float64) - b).mean(axis=(1, 2, 3))}


def text_extractor(a: np.ndarray, b: np.ndarray, c: Config) -> dict[str, np.ndarray]:
    """Share of text pixels of either image, and the difference."""
    x, y = (text_mask(gray_of(p), c.threshold, c.kernel, c.iterations, c.min_area).mean(axis=(1, 2)) for p in (a, b))
    return {"a_text_occupancy": x, "b_text_occupancy": y, "text_occupancy_diff": np.abs(x - y)}


Extractor = Callable[[np.ndarray, np.ndarray, Config], dict[str, np.ndarray]]
EXTRACTORS: dict[str, Extractor] = {"histogram": histogram_extractor, "edge": edge_extractor, "ssim": ssim_extractor, "text": text_extractor}


def _images(column: pa.Array) -> list[np.ndarray | None]:
    """The images (colours, height, width) of a struct column; None where one cannot be read."""
    h, w, data = (column.field(k) for k in range(3))
    out: list[np.ndarray | None] = []
    for i in range(len(column)):
        try:
            raw = data[i].as_buffer() if pa.types.is_binary(data.type) else data[i].values.to_numpy(zero_copy_only=False)
            flat = np.frombuffer(raw, np.uint8) if pa.types.is_binary(data.type) else np.clip(raw, 0, 255).astype(np.uint8)
            height, width = h[i].as_py(), w[i].as_py()
            out.append(np.moveaxis(flat.reshape(height, width, -1), -1, 0) if column[i].is_valid and flat.size in (height * width, 3 * height * width) else None)
        except (AttributeError, TypeError, ValueError):
            out.append(None)
    return out


def _resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    return img if img.shape[1:] == (height, width) else np.stack([px.resize(p, height, width) for p in img])


def extract(pairs: DataFrame, key: list[str], a: str, b: str, config: Config = Config(), extractors: dict[str, Extractor] | None = None, sample: int = 16) -> DataFrame:
    """Key columns, one struct of numbers an extractor, and ``log``.

    All extractors run in one pass over the pairs of images; the second image is
    brought to the size of the first.  Where an extractor fails, or an image
    cannot be read, its numbers are 0.0 and ``log`` has a line for it (empty:
    all went well); the other extractors are not touched.  The names an
    extractor returns are learnt from a blank pair of ``sample`` x ``sample``.
    """
    chosen = EXTRACTORS if extractors is None else extractors
    blank = np.zeros((1, 1, sample, sample), np.uint8)
    names = {}
    for name, fn in chosen.items():
        names[name] = getattr(fn, "names", None) or list(fn(blank, blank, config))
    df = pairs.select(*key, a, b)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    schema += "".join(f", `{n}` struct<{', '.join(f'`{f}`: double' for f in fields)}>" for n, fields in names.items()) + ", log array<string>"

    def one_size(x: np.ndarray, y: np.ndarray, name: str) -> tuple[np.ndarray, list[str | None]]:
        """Numbers (images, fields) of one extractor; a failing stack is taken apart."""
        try:
            got = chosen[name](x, y, config)
            return np.stack([np.broadcast_to(np.asarray(got[f], np.float64), len(x)) for f in names[name]], axis=1), [None] * len(x)
        except Exception as e:  # what an extractor raises is its own affair
            if len(x) == 1:
                return np.zeros((1, len(names[name]))), [f"{name}: {type(e).__name__}: {e}"]
            parts = [one_size(x[i : i + 1], y[i : i + 1], name) for i in range(len(x))]
            return np.concatenate([p[0] for p in parts]), [m for p in parts for m in p[1]]

    def run(batches):
        for batch in parts(batches, 16 << 20, STACK):
            left, right = _images(batch.column(len(key))), _images(batch.column(len(key) + 1))
            logs: list[list[str]] = [[] for _ in left]
            by_size: dict[tuple, list[int]] = {}
            for i, (x, y) in enumerate(zip(left, right)):
                if x is None or y is None:
                    logs[i].append("image cannot be read")
                else:
                    by_size.setdefault((x.shape, y.shape[0]), []).append(i)
            columns = []
            for name, fields in names.items():
                values = np.zeros((len(left), len(fields)))
                for (shape, _), rows in by_size.items():
                    x = np.stack([left[i] for i in rows])
                    y = np.stack([_resized(right[i], *shape[1:]) for i in rows])
                    if x.shape[1] != y.shape[1]:
                        x, y = _three(x), _three(y)
                    got, said = one_size(x, y, name)
                    values[rows] = got
                    for i, m in zip(rows, said):
                        logs[i] += [m] if m else []
                columns.append(pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(len(fields))], fields))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], *columns, pa.array(logs, pa.list_(pa.string()))], names=[*key, *names, "log"])

    return df.mapInArrow(run, schema)
