"""Operators of a training-data pipeline: filtering, deduplication, scoring, packing, sharding.

Nothing outside this subpackage imports it; its queries are listed in ``queries.py``.
"""
