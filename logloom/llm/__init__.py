"""Operators of a training-data pipeline: cleaning, near-duplicates, tokens, models.

Nothing else in the library imports this package.
"""
