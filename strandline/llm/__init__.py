"""Operators for large-scale training-data pipelines, on Spark DataFrames.

Nothing outside this subpackage imports it; `queries` and `sql` hold what the
driver entry registers.
"""
