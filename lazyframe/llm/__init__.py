"""Operators of a training-data pipeline: quality, tokenising, near-duplicates, sharding,
toxicity, media columns, mixing, surrogates, set joins and keyed token files.

Nothing outside this subpackage imports it; its queries are listed in ``queries.py``.
"""
