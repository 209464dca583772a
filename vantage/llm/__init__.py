"""Operators for training-data pipelines: scoring, filtering, sharding, tokenising, deduplication.

Nothing else in the library imports this subpackage.
"""
