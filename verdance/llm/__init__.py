"""Corpus-scale text operators for training-data pipelines.

Every operator is one module with a DataFrame-in, DataFrame-out function; ``queries`` holds the thin
registered queries. Nothing outside this subpackage imports it.
"""
