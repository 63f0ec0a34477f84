"""Metamorphic tests of pixel kernels and layout rules (no Spark)."""

import numpy as np

from chronoweave.operators import layout, pixels


def test_identical_images():
    a = np.random.default_rng(0).integers(0, 256, (24, 32), dtype=np.uint8)
    h = pixels.histogram(a)
    c = pixels.compare_histograms(h, h)
    assert abs(h.sum() - 1) < 1e-9 and abs(c["correlation"] - 1) < 1e-9 and c["chi_square"] == 0 and c["bhattacharyya"] < 1e-6 and abs(c["intersection"] - 1) < 1e-9
    assert pixels.ssim_distance(a, a) == 0 and pixels.mean_absolute_difference(a, a) == 0
    assert pixels.ssim_distance(a[:2, :2], a[:2, :2]) == 1.0
    assert (pixels.resize(a, 24, 32) == a).all() and pixels.resize(a, 12, 16).shape == (12, 16)


def test_blank_and_noise():
    blank, noise = np.full((16, 16), 9, np.uint8), np.random.default_rng(1).integers(0, 256, (16, 16), dtype=np.uint8)
    assert pixels.laplacian_variance(blank) == 0 < pixels.laplacian_variance(noise)
    assert pixels.entropy(blank) < 0.01 < 5 < pixels.entropy(noise) and pixels.ssim_distance(blank, noise) > 0.5


def test_layout_cases():
    box = [[0.0, 0.0, 1.0, 1.0]]
    assert layout.overlap([], []) == {"iou": 1.0, "preservation": 1.0, "loss": 0.0, "valid": True}
    assert layout.overlap([], box) == {"iou": 0.0, "preservation": 0.0, "loss": 1.0, "valid": False}
    assert layout.overlap(box, []) == {"iou": 0.0, "preservation": 0.0, "loss": 1.0, "valid": True}
    assert layout.overlap(box, box)["iou"] == 1.0 and layout.mask(box, 16).sum() == 256


def test_selection_modes():
    from chronoweave.operators.selection import Frame, choose

    frames = [Frame(0, ["a", "a", "b"], frozenset({1, 2}), 0.5, np.array([1.0, 0])), Frame(1, ["a", "c"], frozenset({3}), 1.0, np.array([0, 1.0])), Frame(2, ["a", "c"], frozenset({3}), 0.9, None)]
    for mode in ("A", "B", "C", "D", "E1", "E2", "F"):
        chosen, coverage, reason = choose(frames, mode)
        assert set(chosen) <= {0, 1, 2} and chosen and reason == "coverage_target_reached" and coverage >= 0.95, mode
        assert choose(frames[::-1], mode) == (chosen, coverage, reason)
    assert choose(frames, "B")[0] == [0, 1]
    assert choose([Frame(3, []), Frame(4, [])], "E1") == ([3], 0.0, "fallback_max_standalone_info")
