"""Operators for large training-data pipelines, each a Spark job over a table of texts.

Nothing outside this subpackage imports it. ``queries`` holds the registered
queries and the DuckDB statements they are compared with.
"""
