"""Operators for preparing training text: deduplication, extraction, classifiers, tokens, packing and search."""
