"""Operators for training-data pipelines: extraction, filtering, deduplication, packing and sharding.

Nothing outside this subpackage imports it; its queries are in :mod:`codicil.llm.entries`.
"""
