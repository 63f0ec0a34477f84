"""The chain of vetoes and the raster areas against brute force on invented sessions."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import raster
from chronoweave.functions import vectors as vec
from chronoweave.operators import grouping as gr
from chronoweave.operators import layout, pixels


def random_boxes(rng, n, odd=True):
    out = []
    for _ in range(n):
        x, y = rng.uniform(-0.1, 1.0), rng.uniform(-0.1, 1.0)
        out.append([x, y, x + rng.choice([0.0, 0.02, 0.3, 0.9]), y + rng.choice([0.0, 0.01, 0.04, 0.5])])
    if odd and rng.random() < 0.3:
        out += [[0.25, 0.25, 0.5, 0.5], [0.25, 0.25, 0.5, 0.5], [1.0, 1.0, 1.0, 1.0], [0.0, 0.0, 1.0, 1.0] if rng.random() < 0.2 else [0.9, 0.9, 0.1, 0.1]]
    return out


def test_raster_areas(spark):
    rng = random.Random(1)
    rows = [(i, random_boxes(rng, rng.randrange(8)), random_boxes(rng, rng.randrange(8))) for i in range(60)] + [(100, None, []), (101, [], [[0.1, 0.1, 0.2, 0.2]]), (102, [[0.1, 0.1, 0.2, 0.2]], None), (103, [[1.0, 1.0, 1.0, 1.0]], [[0.0, 0.0, 0.1, 0.1]])]
    df = spark.createDataFrame(rows, "i int, a array<array<double>>, b array<array<double>>").repartition(3)
    got = {r["i"]: r for r in df.select("i", raster.areas(F.col("a"), F.col("b")).alias("n"), raster.layout_change(F.col("a"), F.col("b")).alias("c")).collect()}
    for i, a, b in rows:
        x, y = layout.mask(a), layout.mask(b)
        assert tuple(got[i]["n"]) == (x.sum(), y.sum(), (x & y).sum()), i
        want, c = layout.overlap(a, b), got[i]["c"]
        assert c["valid"] == want["valid"] and abs(c["iou"] - want["iou"]) < 2e-4 and abs(c["preservation"] - want["preservation"]) < 2e-4, i
        assert (c["containment"] is None) == (y.sum() == 0) and (not y.sum() or abs(c["containment"] - (x & y).sum() / y.sum()) < 1e-9)


def test_malformed_boxes_and_hulls(spark):
    df = spark.createDataFrame([([[0.1, 0.1, 0.2], None, [0.1, 0.1, float("nan"), 0.2], [0.5, 0.5, 0.6, 0.6]], [[0.4, 0.3], [0.1, 0.9], None, [0.2]], None)], "b array<array<double>>, p array<array<double>>, q array<array<double>>")
    r = df.select(F.size(raster.whole(F.col("b"))).alias("n"), raster.hull(F.col("p")).alias("h"), raster.hull(F.col("q")).alias("none"), raster.inside(F.col("b")).alias("inside")).first()
    assert (r["n"], r["h"], r["none"], r["inside"]) == (1, [0.1, 0.3, 0.4, 0.9], None, 1)


def test_tile_ssim(spark):
    rng = random.Random(2)
    t = [[float(rng.randrange(256)) for _ in range(64)] for _ in range(6)]
    t.append([x + 1 if x < 255 else x for x in t[0]])
    pairs = [(i, j) for i in range(7) for j in range(7)]
    df = spark.createDataFrame([(t[i], t[j]) for i, j in pairs] + [(None, t[0]), (t[0], t[0][:9])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vec.tile_ssim_distance(F.col("a"), F.col("b"))).collect()]
    for (i, j), d in zip(pairs, got):
        x, y = (np.array(v).reshape(8, 8) for v in (t[i], t[j]))
        assert abs(d - min(1, max(0, 1 - pixels.ssim(x, y, 7).mean()))) < 1e-4
    assert got[-2:] == [1.0, 1.0]


CHROME = ["terminal", "file", "edit", "view", "mainmenu", "help"]


def sessions():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for s in range(24):
        kind = s % 3
        always = CHROME if kind == 0 else ["banner", "logo", "page"] if kind == 1 else []
        base, px = rng.sample(words, 12), [float(rng.randrange(256)) for _ in range(64)]
        for q in range(rng.choice([1, 2, 9, 20])):
            what = rng.random()
            if what < 0.3:
                base = rng.sample(words, rng.randrange(1, 12))
            toks = always + base + (rng.sample(words, 30) if rng.random() < 0.2 else [])
            if rng.random() < 0.1:
                toks = []
            if what < 0.5:
                px = [float(rng.randrange(256)) for _ in range(64)]
            n = rng.choice([0, 1, 1, 4, 6])
            boxes = [[0.1, 0.1 + 0.05 * k, 0.1 + rng.choice([0.2, 0.4, 0.6]), 0.14 + 0.05 * k] for k in range(n)]
            vector = [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]
            rows.append((s, q, toks if rng.random() < 0.95 else None, boxes if rng.random() < 0.95 else None, px if rng.random() < 0.9 else None, vector if rng.random() < 0.8 else None))
    return rows


def half_up(x):
    return math.floor(x * 1e4 + 0.5 + 1e-5) / 1e4


def expected(frames):
    """One session in Python: scores and splits."""
    n = len(frames)
    toks = [list(f[2] or []) for f in frames]
    boxes = [f[3] or [] for f in frames]
    df = collections.Counter(t for x in toks for t in set(x))
    bp = {t for t, c in df.items() if c / n >= 0.7}
    own = [set(x) - bp for x in toks]
    out = []
    for i in range(n - 1):
        px = [frames[k][4] for k in (i, i + 1)]
        d = 1.0 if None in px else round(min(1.0, max(0.0, 1 - pixels.ssim(*(np.array(p).reshape(8, 8) for p in px), 7).mean())), 4)
        a, b = set(toks[i]), set(toks[i + 1])
        jac = 0.0 if not a and not b else 1.0 if not a or not b else half_up(1 - len(a & b) / len(a | b))
        if bp:
            valid = len(own[i]) >= 3
            loss = half_up(1 - half_up(len(own[i] & own[i + 1]) / len(own[i]))) if valid else None
        else:
            valid = len(toks[i]) >= 3
            loss = half_up(1 - half_up(len(a & b) / len(a))) if a else None
        lay = layout.overlap(boxes[i], boxes[i + 1])
        vit = None
        if frames[i][5] and frames[i + 1][5]:
            p, q = np.array(frames[i][5]), np.array(frames[i + 1][5])
            vit = round(min(1.0, max(0.0, (1 - p @ q / ((np.linalg.norm(p) + 1e-9) * (np.linalg.norm(q) + 1e-9))) / 2)), 4)
        terms = [(d, True), (loss, valid and loss is not None), (lay["loss"], lay["valid"]), (vit, vit is not None)]
        mean = lambda w: half_up(sum(k * v for k, (v, ok) in zip(w, terms) if ok) / max(sum(k for k, (_, ok) in zip(w, terms) if ok), 1e-9))
        a1 = half_up((0.4 * d + 0.4 * jac + 0.2 * half_up(1 - lay["iou"])) / (1 + 1e-9))
        out.append({"score_a1": a1, "score_a2": mean([0.4, 0.4, 0.2]), "score_b2": mean([1, 1, 1, 0.5]), "d": d})
    ide = len(bp) >= 5 and any(k in t for t in bp for k in ("terminal", "console", "todo", "run", "pycharm", "vscode", "main", "py"))
    ed = [sum(x1 >= 0.08 and x2 <= 0.95 and y1 >= 0.08 and y2 <= 0.62 for x1, y1, x2, y2 in b) for b in boxes]
    cuts, last = set(), 0
    for i in range(1, n):
        if i - last >= 6 and ed[i] <= 1 and max(ed[max(0, i - 3) : i]) >= 4:
            cuts.add(i - 1)
            last = i
    for i, r in enumerate(out):
        r["kind"] = "ide" if ide else "blackboard" if len(bp) <= 2 else "slides"
        r["a1"] = int(r["score_a1"] >= 0.35)
        for k in ("a2", "b2"):
            p = int(r[f"score_{k}"] >= 0.35 and r["d"] >= 0.025)
            r["popped"] = i > 0 and len(own[i]) > len(own[i - 1]) + 8 and len(own[i]) > len(own[i + 1]) + 8 and len(own[i - 1]) > 0 and len(own[i - 1] & own[i + 1]) / len(own[i - 1]) >= 0.5
            p = 0 if r["popped"] else p
            if r["kind"] == "ide":
                p = int(i in cuts)
            elif r["kind"] == "blackboard" and p:
                x, y = layout.mask(boxes[i]), layout.mask(boxes[i + 1])
                r["wiped"] = y.sum() > 0 and (x & y).sum() / y.sum() >= 0.7
                p = 0 if r["wiped"] else p
            r[k] = p
    return out


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(sessions(), "session int, seq int, tokens array<string>, boxes array<array<double>>, tile array<double>, embedding array<double>").repartition(3).cache()


def test_chain(frames):
    by = collections.defaultdict(list)
    for r in sessions():
        by[r[0]].append(r)
    want = {(s, i): r for s, f in by.items() for i, r in enumerate(expected(f))}
    assert {r["kind"] for r in want.values()} == {"ide", "blackboard", "slides"}
    assert any(r["popped"] for r in want.values()) and any(r.get("wiped") for r in want.values()) and any(r["kind"] == "ide" and r["a2"] for r in want.values()) and any(r["d"] < 0.025 for r in want.values())
    got = {(r["session"], r["seq"]): r for r in gr.splits(frames).where("paired").collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in ("score_a1", "score_a2", "score_b2"):
            assert abs(got[k][c] - w[c]) < 2e-4, (k, c, got[k], w)
        near = any(abs(w[c] - 0.35) < 2e-4 for c in ("score_a1", "score_a2", "score_b2"))
        assert near or all(got[k][c] == w[c] for c in ("kind", "a1", "a2", "b2")), (k, got[k], w)


def test_groups_follow_splits(frames):
    split = {(r["session"], r["seq"]): r for r in gr.splits(frames).collect()}
    got = {(r["session"], r["seq"]): r for r in gr.groups(frames).collect()}
    for k in ("a1", "a2", "b2"):
        for (s, q), r in got.items():
            assert r[f"group_{k}"] == 1 + sum(split[s, p][k] for p in range(q))
    total = collections.Counter(r["approach"] for r in gr.summaries(frames).collect())
    assert total == {k.upper(): len({(s, r[f"group_{k}"]) for (s, _), r in got.items()}) for k in ("a1", "a2", "b2")}


def test_divergences_and_settings(frames):
    f = gr.splits(frames)
    d = gr.divergences(f).collect()
    assert len(d) == f.where("paired and not (a1 = a2 and a2 = b2)").count() and all(r["diff_summary"] for r in d)
    free = gr.splits(frames, gr.Settings(boilerplate=None, gate=0.0, bridge=False))
    assert {r["kind"] for r in free.select("kind").distinct().collect()} == {"blackboard"}  # no boilerplate, no other class
    assert gr.groups(frames.limit(0)).count() == 0
