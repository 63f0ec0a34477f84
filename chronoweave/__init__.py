"""Sequence-change analytics on Spark: compare, score, cut, select, evaluate."""
