"""Stacked image kernels against pixel-by-pixel Python, and failures inside the one pass."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import images as im
from chronoweave.operators import pixels as px
from chronoweave.operators.batches import parts

RNG = np.random.default_rng(4)


def brute_components(mask):
    label, sizes = np.full(mask.shape, -1), []
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x] < 0:
            todo, label[y, x], n = [(y, x)], len(sizes), 0
            while todo:
                a, b = todo.pop()
                n += 1
                for p in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for q in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[p, q] and label[p, q] < 0:
                            label[p, q] = len(sizes)
                            todo.append((p, q))
            sizes.append(n)
    return label, sizes


@pytest.mark.parametrize("share", [0, 0.1, 0.35, 0.5, 0.9, 1])
@pytest.mark.parametrize("shape", [(4, 9, 13), (1, 1, 1), (3, 1, 20), (3, 20, 1)])
def test_components(share, shape):
    masks = RNG.random(shape) < share
    c = im.Components(masks)
    for least in (1, 3, 8):
        got = c.keep(c.size[c.label] >= least)
        for m, g in zip(masks, got):
            label, sizes = brute_components(m)
            assert (g == (np.isin(label, [k for k, n in enumerate(sizes) if n >= least]))).all()


@pytest.mark.parametrize("kernel,times", [(1, 1), (2, 1), (3, 1), (3, 2), (5, 2), (4, 3)])
def test_dilate(kernel, times):
    m = RNG.random((2, 11, 14)) < 0.05
    want = m.copy()
    for _ in range(times):
        old = want.copy()
        for n, y, x in zip(*np.nonzero(np.ones_like(old))):
            y0, x0 = max(0, y - kernel // 2), max(0, x - kernel // 2)
            want[n, y, x] = old[n, y0 : y + kernel - kernel // 2, x0 : x + kernel - kernel // 2].any()
    assert (im.dilate(m, kernel, times) == want).all()


def brute_canny(g, low, high):
    h, w = g.shape
    v = lambda y, x: int(g[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    d = {}
    for y in range(h):
        for x in range(w):
            dx = sum(k * (v(y + j, x + 1) - v(y + j, x - 1)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            dy = sum(k * (v(y + 1, x + j) - v(y - 1, x + j)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            d[y, x] = dx, dy
    m = lambda y, x: sum(map(abs, d[y, x])) if (y, x) in d else 0
    weak = set()
    for (y, x), (dx, dy) in d.items():
        s, t = m(y, x), abs(dy) * 32768
        if t < abs(dx) * 13573:
            top = s > m(y, x - 1) and s >= m(y, x + 1)
        elif t > abs(dx) * (13573 + 65536):
            top = s > m(y - 1, x) and s >= m(y + 1, x)
        else:
            side = -1 if (dx < 0) != (dy < 0) else 1
            top = s > m(y - 1, x - side) and s > m(y + 1, x + side)
        if top and s > low:
            weak.add((y, x))
    todo = [p for p in weak if m(*p) > high]
    out = set(todo)
    while todo:
        y, x = todo.pop()
        for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
            if p in weak and p not in out:
                out.add(p)
                todo.append(p)
    return out


def test_canny():
    noise = RNG.integers(0, 256, (3, 12, 17)).astype(np.uint8)
    square = np.zeros((1, 12, 17), np.uint8)
    square[0, 3:9, 4:12] = 200
    flat = np.full((1, 12, 17), 7, np.uint8)
    for stack in (noise, square, flat, im.blur(noise, 5)):
        for low, high in ((50, 150), (0, 300), (400, 500)):
            got = im.canny(stack, low, high)
            for g, e in zip(stack, got):
                assert set(zip(*map(lambda a: a.tolist(), np.nonzero(e)))) == brute_canny(g, low, high)
    assert not im.canny(flat).any() and im.canny(square).any()


def test_blurs_and_threshold():
    g = RNG.integers(0, 256, (2, 9, 11)).astype(np.uint8)
    for size in (3, 5, 7, 9):
        w = np.array(im.BLURS[size]) / 256 if size in im.BLURS else im.gaussian(size)
        r, got = size // 2, im.blur(g, size)
        wide = np.pad(g.astype(float), ((0, 0), (r, r), (r, r)), "reflect")
        for n, y, x in np.ndindex(g.shape):
            want = (wide[n, y : y + size, x : x + size] * np.outer(w, w)).sum()
            assert abs(int(got[n, y, x]) - want) <= 0.5 + 1e-9
    assert (im.blur(np.full((1, 8, 8), 77, np.uint8), 5) == 77).all()
    assert (im.adaptive(np.full((1, 8, 8), 77, np.uint8)) == 255).all()  # even pictures are over their mean less two
    assert im.preprocess(g, "none") is g and set(np.unique(im.preprocess(g, "adaptive", 3))) <= {0, 255}
    with pytest.raises(ValueError):
        im.preprocess(g, "sepia")


def test_histograms_by_cell():
    g = RNG.integers(0, 256, (3, 2, 10, 7)).astype(np.uint8)
    cell = im.cells(10, 7, 4)
    h = im.histograms(g, 16, 1e-10, cell, 16)
    for n in range(3):
        for k in range(16):
            part = np.concatenate([np.bincount(g[n, c][cell == k] // 16, minlength=16) for c in range(2)])
            want = (part + 1e-10) / (part + 1e-10).sum()
            assert np.allclose(h[n, k], want)
    assert np.unique(im.cells(2, 2, 4)).size == 4  # cells without a pixel
    whole = px.histogram(g[0, 0], 16)
    assert np.allclose(im.histograms(g[:1, :1], 16, 1e-10)[0, 0], whole)
    other = px.histogram(g[1, 0], 16)
    for k, v in px.compare_histograms(whole, other).items():
        assert abs(float(im.compare(whole, other)[k.replace("chi_square", "chisquare")]) - v) < 1e-6 * max(1, abs(v))


def test_similarity_map():
    a, b = (RNG.integers(0, 256, (2, 16, 14)).astype(np.uint8) for _ in range(2))
    s, mean = im.ssim_map(a, b, 7, False)
    for k in range(2):
        assert np.allclose(s[k, 3:-3, 3:-3], px.ssim(a[k], b[k], 7)) and abs(mean[k] - px.ssim(a[k], b[k], 7).mean()) < 1e-9
    s, mean = im.ssim_map(a, a)
    assert np.allclose(s, 1) and np.allclose(mean, 1)
    with pytest.raises(ValueError):
        im.ssim_map(a[:, :2], b[:, :2])


def test_one_pass(spark):
    img = lambda h, w, c, seed: (h, w, np.random.default_rng(seed).integers(0, 256, h * w * c).astype(np.uint8).tobytes())
    rows = [(i, img(16, 20, 1 + 2 * (i % 2), i), img(16 if i < 6 else 9, 20, 1 + 2 * (i % 3 == 0), 50 + i)) for i in range(9)]
    rows += [(100, None, rows[0][1]), (101, (3, 3, b"123"), rows[0][1]), (102, (2, 2, b"1234"), (2, 2, b"4321")), (103, (None, 3, b""), rows[0][1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "i int, a struct<height: int, width: int, pixels: binary>, b struct<height: int, width: int, pixels: binary>, log string").repartition(2)

    def picky(a, b, c):
        if len(a) == 1 and a.mean() > 127 and a.shape[2] > 2:
            raise RuntimeError("too bright")
        if len(a) > 1 and (a.mean(axis=(1, 2, 3)) > 127).any():
            raise RuntimeError("one of them is too bright")
        return {"mean": a.mean(axis=(1, 2, 3))}

    got = {r["i"]: r for r in im.extract(df, ["i"], "a", "b", im.Config(min_area=5), im.EXTRACTORS | {"picky": picky}).collect()}
    assert set(got) == {r[0] for r in rows}
    planes = lambda s: np.moveaxis(np.frombuffer(s[2], np.uint8).reshape(s[0], s[1], -1), -1, 0)
    for i, a, b in rows[:9]:
        r, p = got[i], planes(a)
        bright = p.mean() > 127
        assert r["log"] == (["picky: RuntimeError: too bright"] if bright else []) and abs(r["picky"]["mean"] - (0 if bright else p.mean())) < 1e-9
        assert abs(r["histogram"]["a_brightness"] - im.gray_of(p[None])[0].mean()) < 1e-9
        assert abs(r["text"]["a_text_occupancy"] - im.text_mask(im.gray_of(p[None]), min_area=5).mean()) < 1e-9
        assert len(r["histogram"]) + len(r["edge"]) + len(r["ssim"]) + len(r["text"]) == 2 * 30 + 59
    for i in (100, 101, 103):
        assert got[i]["log"] == ["image cannot be read"] and got[i]["ssim"]["ssim_mean"] == 0.0 and set(got[i]["histogram"]) == {0.0}
    assert any(m.startswith("ssim: ValueError") for m in got[102]["log"])  # too small for any window; the others still count
    assert im.extract(df.limit(0), ["i"], "a", "b").count() == 0
    assert got[0]["edge"]["a_edge_density"] > 0
    assert df.select(F.col("i")).count() == len(rows)


def test_stacks_do_not_grow_with_batches(spark):
    def size(a, b, c):
        return {"n": np.full(len(a), len(a), float)}

    image = F.struct(F.lit(2).alias("height"), F.lit(2).alias("width"), F.array(*[F.lit(1.0)] * 4).alias("pixels"))
    df = spark.range(0, 1000, 1, 1).select("id", image.alias("a"), image.alias("b"))
    got = im.extract(df, ["id"], "a", "b", extractors={"size": size}).collect()
    assert sorted(r["id"] for r in got) == list(range(1000)) and max(r["size"]["n"] for r in got) <= im.STACK


def test_parts_of_batches():
    batch = pa.RecordBatch.from_pydict({"k": list(range(1000)), "t": ["x" * 100] * 999 + ["y" * 100_000]})
    got = list(parts([batch, batch.slice(0, 0), batch.slice(990)], 10_000, 50))
    assert [k for p in got for k in p.column(0).to_pylist()] == [*range(1000), *range(990, 1000)]
    assert all(p.num_rows == 1 or p.num_rows <= 50 and p.nbytes <= 10_000 for p in got)
