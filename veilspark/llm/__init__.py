"""Operators of a training-data pipeline: extraction, deduplication, mixing, packing, encoding and scoring.

Nothing outside this subpackage imports it. Each module holds one operator; ``queries`` derives the registered
query results from them.
"""
