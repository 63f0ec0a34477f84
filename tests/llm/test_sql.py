"""Training-data queries that SQL can express equal DuckDB, whole results; and what one suffix order would miss."""

import glob
import os
import random

import duckdb
import pytest

from chronoweave.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.01"


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda names, rows: sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in rows)
    assert key(df.columns, [tuple(r) for r in df.collect()]) == key(columns, want.fetchall())


def brute(texts):
    """(doc, word) covered by a window of 50 words that stands in two documents and is not its first place."""
    words = {i: t.split() for i, t in texts.items()}
    owners, first = {}, {}
    for i in sorted(words):
        for s in range(len(words[i]) - 49):
            w = tuple(words[i][s : s + 50])
            owners.setdefault(w, set()).add(i)
            first.setdefault(w, (i, s))
    return {(i, j) for i, w in words.items() for s in range(len(w) - 49) if len(owners[h := tuple(w[s : s + 50])]) > 1 and first[h] != (i, s) for j in range(s, s + 50)}


def test_links_with_different_neighbours(spark):
    """Many copies of parts of one passage, cut at every side, so that suffix neighbours differ from the documents that share a window."""
    rng = random.Random(12)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(160)]
    texts = {}
    for i in range(60):
        a = rng.randrange(0, 100)
        b = rng.randrange(a + 30, 161)
        texts[i] = " ".join([f"x{i}_{k}" for k in range(rng.randrange(20))] + passage[a:b] + [f"y{i}_{k}" for k in range(rng.randrange(20))])
    d = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(4)
    got = suffix_dedup.passages(d).where("removed").collect()
    assert {(r["doc_id"], j) for r in got for j in range(r["start_word"], r["start_word"] + r["n_words"])} == brute(texts)
