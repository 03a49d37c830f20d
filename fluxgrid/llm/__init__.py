"""Operators for large text corpora: deduplication, filtering, mixing, tokenised output, search.

Nothing else in the package imports this subpackage.
"""
