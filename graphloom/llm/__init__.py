"""Operators of a training-data pipeline: tokenizing, deduplication, mixing, fingerprints, search, filters.

Nothing else in the package imports this subpackage; it imports nothing of its siblings either.
"""
