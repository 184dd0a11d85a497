"""Operators for preparing text corpora: fingerprints, near duplicates, quality filters, sharding, packing.

Nothing outside this folder imports it.
"""
