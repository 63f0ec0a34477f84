"""A corpus pipeline: every stage applies one operator to what the one before kept.

Stages: language identification (documents without a language go), SimHash
near-dedup completed by a prefix join (one document of each group that five-word
shingles link at Jaccard similarity 0.8 stays), suffix-array dedup (passages
that repeat across documents stay once) and best-fit packing.  All but the
last return the columns of ``documents``.

Null and empty texts have no letter and go at the first stage; of rows that
repeat an id the second stage leaves one, that with the first text in order; of
equal texts the smallest id stays.  An empty table passes through all
stages and gives no pieces.  Extra columns are carried to the last stage and
dropped there.  A very long text is worked on whole by one task of each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import langid, near_copies, packing, suffix_dedup
from chronoweave.llm.common import Scratch, small_batches
from chronoweave.llm.queries import vocabulary

#: SQL cannot express a network, XXH64 or BPE.  Tests hold the whole run against brute force from the second stage on.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told."""
    small_batches(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    small_batches(spark)
    return near_copies.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of passages of 50 words or more."""
    small_batches(spark)
    return suffix_dedup.strip(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 1024 tokens."""
    small_batches(spark)
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("simhash_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.table(docs)
    return docs
