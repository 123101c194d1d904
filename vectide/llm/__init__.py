"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it. ``queries`` holds the registered
queries, one per operator, and ``sql`` their DuckDB equivalents.
"""
