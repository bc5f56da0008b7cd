"""Operators for preparing training text: one module per operator, `catalog` for the queries over the given tables.

Nothing outside this package imports it; `corpus_pipeline.py` and `__spark_entry__.py` build on it.
"""
