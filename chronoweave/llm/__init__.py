"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and parameters and returns DataFrames; ``queries`` holds the thin
registered queries that derive the digest columns from them.
"""
