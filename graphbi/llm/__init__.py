"""Operators of a training-data pipeline: scoring, deduplication, decontamination, encoding, archives.

Nothing else in the library imports this package.
"""
