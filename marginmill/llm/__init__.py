"""Operators for building training corpora: language ID, URL filters, archives, sharding,
similarity joins, line deduplication, decontamination, mixing, quality rules and chat formatting.

Nothing outside this package imports it.
"""
