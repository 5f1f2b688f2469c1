"""Operators for training-data pipelines: near-duplicates, search, mixing, scans, tokens, language models.

Nothing else in the library imports this package.
"""
