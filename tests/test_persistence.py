"""Distances to neighbours against a blockwise search written out, with odd sessions."""

import random

from pyspark.sql import functions as F

from chronoweave.operators import persistence as ps


def blocks(a, b):
    """Tokens in matching blocks, longest first, by trying every start."""
    popular = {t for t in b if len(b) >= 200 and b.count(t) > len(b) // 100 + 1}

    def search(alo, ahi, blo, bhi):
        best = (0, alo, blo)
        for i in range(alo, ahi):
            for j in range(blo, bhi):
                n = 0
                while i + n < ahi and j + n < bhi and a[i + n] == b[j + n] and b[j + n] not in popular:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            n, i, j = n + 1, i - 1, j - 1
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        return n and n + search(alo, i, blo, j) + search(i + n, ahi, j + n, bhi)

    return search(0, len(a), 0, len(b))


def test_edit_distance():
    rng = random.Random(3)
    for n, words in [(0, 3), (1, 1), (6, 2), (20, 3), (40, 12), (230, 20), (230, 400)]:
        for _ in range(4):
            a = [f"t{rng.randrange(words)}" for _ in range(n)]
            b = [t for t in a if rng.random() < 0.7] + [f"t{rng.randrange(words)}" for _ in range(n // 4)]
            want = 1 - 2 * blocks(a, b) / (len(a) + len(b)) if a or b else 0.0
            assert abs(ps.edit_distance(a, b) - want) < 1e-12
    assert ps.edit_distance([], ["x"]) == 1.0 == ps.edit_distance(["x"], [])


def test_neighbours(spark):
    rng = random.Random(4)
    rows = [(s, q, None if rng.random() < 0.1 else [f"t{rng.randrange(6)}" for _ in range(rng.randrange(8))], "kept") for s in range(5) for q in range([1, 2, 7, 12, 12][s])]
    df = spark.createDataFrame(rows, "s int, seq int, tokens array<string>, kind string").repartition(3)
    got = {(r["s"], r["seq"]): r for r in ps.distances(df, "s", "seq", "tokens", [1, 5, -3], [(2, 1)], ["kind"]).collect()}
    at = {(s, q): t or [] for s, q, t, _ in rows}
    far = lambda x, y: ps.edit_distance(at[x], at[y]) if x in at and y in at else None
    assert len(got) == len(rows)
    for (s, q), r in got.items():
        assert r["kind"] == "kept"
        assert (r["d1"], r["d5"], r["d_3"], r["b2_1"]) == (far((s, q), (s, q + 1)), far((s, q), (s, q + 5)), far((s, q - 3), (s, q)), far((s, q - 2), (s, q + 1)))
    assert ps.distances(df.limit(0), "s", "seq", "tokens", [1]).count() == 0


def test_patterns(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0.0), (0.9, 0.0, 0.9), (0.9, 0.9, 0.9), (0.0, 0.9, 0.9), (0.0, 0.0, 0.0)], "before double, after double, across double")
    c = [F.col(x) for x in ("before", "after", "across")]
    got = [tuple(r) for r in df.select(ps.chosen_pattern(*c), ps.truth_pattern(c[0], c[1])).collect()]
    assert got == [("transient", "transition"), ("persistent", "settled"), ("evolving", "transition"), ("continuous", "pre-transition"), ("continuous", "continuous")]
