"""Pixel kernels on gray or RGB uint8 arrays, from their public formulas."""

from __future__ import annotations

import numpy as np


def gray(rgb: np.ndarray) -> np.ndarray:
    """0.299 R + 0.587 G + 0.114 B, rounded."""
    return np.rint(rgb[..., :3].astype(np.float64) @ (0.299, 0.587, 0.114)).astype(np.uint8)


def histogram(img: np.ndarray, bins: int = 64, eps: float = 1e-10) -> np.ndarray:
    """Of [0, 256), eps added, summing to 1."""
    h = np.bincount((img.astype(np.int64) * bins // 256).ravel(), minlength=bins) + eps
    return h / h.sum()


def compare_histograms(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Correlation, intersection, Bhattacharyya and chi-square (bins with a near 0 skipped)."""
    x, y = a - a.mean(), b - b.mean()
    spread = np.sqrt((x * x).sum() * (y * y).sum())
    some = np.abs(a) > np.finfo(float).eps
    return {
        "correlation": float((x * y).sum() / spread) if spread > 0 else 1.0,
        "intersection": float(np.minimum(a, b).sum()),
        "bhattacharyya": float(np.sqrt(max(0.0, 1 - np.sqrt(a * b).sum() / np.sqrt(a.sum() * b.sum())))),
        "chi_square": float((((a - b) ** 2)[some] / a[some]).sum()),
    }


def entropy(img: np.ndarray) -> float:
    p = np.bincount(img.ravel(), minlength=256) / max(1, img.size)
    return float(-(p * np.log2(p + 1e-7)).sum())


def laplacian_variance(img: np.ndarray) -> float:
    """Sharpness: variance of the 4-neighbour Laplacian, borders mirrored; 0 for images under 2 x 2."""
    if img is None or min(img.shape[:2]) < 2:
        return 0.0
    p = np.pad(img.astype(np.float64), 1, "reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7, span: float = 255.0) -> np.ndarray:
    """The map of structural similarities over uniform windows (sample covariance)."""
    window = min(window, *a.shape)
    window -= 1 - window % 2
    if window < 3:
        raise ValueError("images under 3 x 3 have no window")
    n = window * window
    mean = lambda x: np.lib.stride_tricks.sliding_window_view(x, (window, window)).mean(axis=(2, 3))
    x, y = a.astype(np.float64), b.astype(np.float64)
    mx, my = mean(x), mean(y)
    k = n / (n - 1)
    vx, vy, vxy = k * (mean(x * x) - mx * mx), k * (mean(y * y) - my * my), k * (mean(x * y) - mx * my)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return ((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))


def ssim_distance(a: np.ndarray, b: np.ndarray) -> float:
    """1 - mean similarity clipped to [0, 1], 4 decimals; 1 if it cannot be computed."""
    try:
        return round(float(min(1.0, max(0.0, 1 - ssim(a, b, 11).mean()))), 4)
    except (ValueError, AttributeError):
        return 1.0


def mean_absolute_difference(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a.astype(np.float32) - b.astype(np.float32)).mean())


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y = np.clip((np.arange(height) + 0.5) * img.shape[0] / height - 0.5, 0, img.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * img.shape[1] / width - 0.5, 0, img.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    f = img.astype(np.float64)
    top = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx
    low = f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(img.dtype)
