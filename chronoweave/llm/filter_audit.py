"""How quality filters interact: what each order of filters removes, and Shapley values.

Every document gets the set of filters that it fails (a mask).  Of each part
only the number of documents of each mask is kept.  With x_i the degree to
which filter i is applied, these numbers give the part's removal polynomial

    R(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)),

which is multilinear.  At a corner (each x_i 0 or 1) it is the number of
documents that a set of filters removes, so what any order keeps and removes is
read off corners.  The Shapley value of filter i is the integral of the partial
derivative dR/dx_i along the diagonal from 0 to 1, taken with exact rationals;
times the number of orders it is the sum of its removals over all orders.

Defined cases: a null text is the empty text; a null part is the empty string;
a text without a word does not fail the share of distinct words; a document is
good or toxic if any of its label rows says so; of equal texts those rows with
the smallest id pass (rows that repeat this id all do; rows without an id pass
only where no row with one has the text); an empty table gives no rows; extra
columns never reach the operator.  Equal texts are told by SHA-256.  A very
long text needs memory for its words, nothing else grows with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Scratch

#: Fixed value: the class of white space that splits words.
SPACE = r"[ \x09-\x0D]+"


class Removal:
    """The removal polynomial of counts by mask, by its coefficients of the products of variables."""

    def __init__(self, counts: Mapping[int, int], k: int) -> None:
        above = [counts.get(m, 0) for m in range(1 << k)]
        for i in range(k):  # counts of all masks that hold a set
            for m in range(1 << k):
                if not m >> i & 1:
                    above[m] += above[m | 1 << i]
        self.total, self.k = above[0], k
        self.coefficients = [0] + [(-1) ** (m.bit_count() + 1) * above[m] for m in range(1, 1 << k)]

    def corner(self, chosen: int) -> int:
        """How many rows the filters in ``chosen`` remove."""
        return sum(c for m, c in enumerate(self.coefficients) if m & chosen == m)

    def shapley(self, i: int) -> int:
        """Removals of filter i, summed over all orders."""
        # dR/dx_i on the diagonal is the sum of c * t^(|m| - 1) over the products with x_i.
        value = sum((Fraction(c, m.bit_count()) for m, c in enumerate(self.coefficients) if m >> i & 1), Fraction(0))
        scaled = value * math.factorial(self.k)
        if scaled.denominator != 1:
            raise ArithmeticError("a Shapley value times the number of orders is a whole number")
        return int(scaled)


def rows_of(part: str, names: str, counts: dict[str, dict[int, int]]) -> Iterator[tuple]:
    """Every order and step of one part."""
    k = len(names)
    all_, good, toxic = (Removal(counts[c], k) for c in ("n", "good", "toxic"))
    corners = {c: [p.corner(m) for m in range(1 << k)] for c, p in (("n", all_), ("good", good), ("toxic", toxic))}
    shapley, whole = [all_.shapley(i) for i in range(k)], (1 << k) - 1
    n = corners["n"]
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = n[after] - n[before]
            yield (
                part, "".join(names[j] for j in order), step, names[i], all_.total - n[after], removed, n[1 << i] - removed, n[whole] - n[whole ^ 1 << i],
                corners["good"][after] - corners["good"][before], corners["toxic"][after] - corners["toxic"][before], shapley[i],
            )
            before = after


def interactions(df: DataFrame, filters: Mapping[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """One row per part, order of the filters and step.

    ``filters`` maps a letter to the condition of failure (at most six
    filters: rows and work grow with the factorial); null does not fail.  Rows
    are counted by part and mask before any shuffle, so a part of any size is a
    few rows; parts are then worked on side by side.
    """
    names = "".join(filters)
    if len(names) != len(filters) or len(names) > 6:
        raise ValueError("filters need names of one letter, six of them at most")
    bit = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0)
    mask = reduce(Column.bitwiseOR, [bit(c, 1 << i) for i, c in enumerate(filters.values())])
    counts = df.groupBy(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.sum(bit(good, 1)).alias("good"), F.sum(bit(toxic, 1)).alias("toxic"))
    per = counts.groupBy("part").agg(*[F.collect_list(c).alias(c) for c in ("mask", "n", "good", "toxic")])  # at most 2^6 rows a part
    fields = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    types = [pa.string(), pa.string(), pa.int32(), pa.string()] + [pa.int64()] * 7

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                cols = zip(*rows_of(r["part"], names, {c: dict(zip(r["mask"], r[c])) for c in ("n", "good", "toxic")}))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=fields)

    return per.mapInArrow(run, "part string, filter_order string, step int, filter string, " + ", ".join(f"{f} long" for f in fields[4:]))


def audit(docs: DataFrame, labels: DataFrame, least: int = 200, distinct: int = 50, capitals: int = 3, marks: str = r"[#$%&*|]") -> DataFrame:
    """The five filters of the contract: short, repetitive, shouting, marked and copied texts."""
    scratch = Scratch(docs.sparkSession, "audit")
    text = F.coalesce(docs["text"], F.lit(""))
    words = F.array_remove(F.split("text", SPACE), "")
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), text.alias("text"))
    d = d.withColumn("words", words).select(
        "doc_id", "lang", (F.size("words") < least).alias("a"), (100 * F.size(F.array_distinct("words")) < distinct * F.size("words")).alias("b"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > capitals * F.length("text")).alias("c"), F.rlike("text", F.lit(marks)).alias("d"), F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    d = scratch.table(d)  # narrow: the texts are read once
    first = d.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumn("is_first", F.lit(True))
    said = labels.groupBy(labels["doc_id"].alias("labelled")).agg(F.max((labels["quality"] == 1).cast("int")).alias("good"), F.max((labels["toxic"] == 1).cast("int")).alias("toxic"))
    # Both keys of this join spread the copies of one text over all tasks.
    d = d.join(first, (d["digest"] == first["digest"]) & d["doc_id"].eqNullSafe(first["first"]), "left").drop(first["digest"])
    d = d.join(said, d["doc_id"] == said["labelled"], "left")
    filters = {"A": F.col("a"), "B": F.col("b"), "C": F.col("c"), "D": F.col("d"), "E": F.col("is_first").isNull()}
    return interactions(d, filters, F.col("lang"), F.col("good") == 1, F.col("toxic") == 1)
