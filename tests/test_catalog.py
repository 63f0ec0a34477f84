"""Every query with SQL equals DuckDB."""

import glob
import os

import duckdb
import pytest

from chronoweave.plans import catalog, evaluation, exports, keyframes, lessons, persistence, pictures, runs  # noqa: F401
from chronoweave.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str.lower, columns)) == sorted(map(str.lower, df.columns))
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, want.fetchall())


def test_cover_modes():
    from chronoweave.operators.selection import cover

    assert cover([]) == ([], 0.0, "empty_group")
    assert cover([(0, []), (1, [])])[0] == [0]
    assert cover([(0, ["a", "a"]), (1, ["a", "b"])], "A") == ([1], 1.0, "coverage_target_reached")
    assert cover([(0, ["a", "a"]), (1, ["a", "b"])], "B") == ([0, 1], 1.0, "coverage_target_reached")
