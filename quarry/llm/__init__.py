"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL counterparts.
"""
