"""Reading order on small pages."""

from chronoweave.operators import reading_order as ro


def block(k, x1, y1, x2, y2, font=20.0):
    return {"block": k, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "font": font}


def test_title_over_two_columns():
    page = [block(1, 0, 0, 800, 30, 30.0), block(4, 500, 100, 800, 120), block(2, 0, 100, 300, 120), block(3, 0, 125, 300, 145), block(5, 500, 125, 800, 145)]
    got = ro.order(page)
    assert [r[0] for r in got] == [1, 2, 3, 4, 5]
    assert [r[2] for r in got] == ["row"] + ["column"] * 4
    assert [r[3] for r in got] == [None, 1, 1, 2, 2]
    assert got[1][1] == got[2][1] != got[3][1] == got[4][1]
    assert [r[5] for r in got] == [1, 2, 3, 4, 5]


def test_blocks_of_a_line_read_left_to_right():
    assert [r[0] for r in ro.order([block(2, 50, 3, 90, 23), block(1, 0, 0, 40, 20)])] == [1, 2]
    assert ro.order([]) == []


def test_pages_apart(spark):
    rows = [("p", 1, 0, 0, 9, 9, 9), ("q", 1, 0, 0, 9, 9, 9), ("q", 2, 0, 100, 9, 109, 9), ("q", 3, None, 0, 9, 9, 9)]
    df = spark.createDataFrame(rows, "page string, block int, x1 int, y1 int, x2 int, y2 int, font int")
    got = sorted((r.page, r.block, r.position) for r in ro.analyse(df, "page").collect())
    assert got == [("p", 1, 1), ("q", 1, 1), ("q", 2, 2)]


def test_only_the_last_block_of_a_paragraph_counts():
    # The third block is near the hull of the first two, but far below the lower one's end and of another font.
    page = [block(1, 0, 0, 300, 20), block(2, 0, 25, 300, 45, 25.0), block(3, 0, 50, 300, 70, 31.0), block(4, 0, 75, 300, 95, 20.0), block(5, 0, 200, 300, 220)]
    got = {r[0]: r[1] for r in ro.order(page)}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 3}


def test_columns_count_anew_in_each_band():
    two = lambda y, k: [block(k, 0, y, 300, y + 20), block(k + 1, 600, y, 900, y + 20)]
    page = two(0, 1) + [block(3, 0, 100, 900, 140, 40.0)] + two(200, 4)
    assert [(r[0], r[2], r[3]) for r in ro.order(page)] == [(1, "column", 1), (2, "column", 2), (3, "row", None), (4, "column", 1), (5, "column", 2)]


def test_order_is_whole_and_does_not_depend_on_the_input(spark):
    import random

    rng = random.Random(6)
    pages = {}
    for p in range(25):
        cells = rng.sample(range(200), rng.randint(1, 30))
        pages[p] = [block(i, 130 * (c % 10) + rng.randint(0, 9), 40 * (c // 10) + rng.randint(0, 5), 130 * (c % 10) + rng.choice([60, 120, 700]), 40 * (c // 10) + 25, rng.choice([12.0, 20.0, 40.0])) for i, c in enumerate(cells)]
    rows = [(p, *[b[c] for c in ro.COLUMNS], "clash") for p, bs in pages.items() for b in bs]
    df = spark.createDataFrame([(p, k, *map(float, v[:-1]), v[-1]) for p, k, *v in rows], "p int, block int, x1 double, y1 double, x2 double, y2 double, font double, blocks string").repartition(3)
    got = sorted(tuple(r) for r in ro.analyse(df, "p").collect())
    assert got == sorted((p, *r) for p, bs in pages.items() for r in ro.order(rng.sample(bs, len(bs))))
    for p, bs in pages.items():
        mine = sorted((r for r in got if r[0] == p), key=lambda r: r[6])
        assert [r[6] for r in mine] == list(range(1, len(bs) + 1)) and {r[1] for r in mine} == {b["block"] for b in bs}
        assert [r[2] for r in mine] == sorted(r[2] for r in mine) and [r[5] for r in mine] == sorted(r[5] for r in mine)  # paragraphs and lines are never torn apart
    assert ro.analyse(df.limit(0), "p").count() == 0


def test_block_type(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from chronoweave.functions import text as tx

    def plain(t):
        t = (t or "").replace(" ", "")
        n = {"m": 0, "l": 0, "d": 0}
        for c in t:
            n["m" if unicodedata.category(c) == "Sm" or "Ͱ" <= c <= "Ͽ" else "l" if c.isalpha() else "d" if c.isdigit() else "o"] = n.get("m" if unicodedata.category(c) == "Sm" or "Ͱ" <= c <= "Ͽ" else "l" if c.isalpha() else "d" if c.isdigit() else "o", 0) + 1
        return "formula" if t and ("=" in t or n["d"] + n["m"] > n["l"] or (n["m"] > 0 and n["l"] < 5) or (len(t) <= 6 and n["d"] > 0 and n["l"] <= 2)) else "text"

    texts = [None, "", "  ", "hello", "x = 1", "α", "αβγ words here", "sum ∑ of all things", "a+b", "x2", "ab12cd", "2024", "Figure 12", "x²y³", "été 日本", "!?", "∀x∃y", "no+thing else", "3 a b c d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.block_type(F.col("t"))).collect()] == [plain(t) for t in texts]
