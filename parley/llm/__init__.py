"""Operators for preparing training data: selection, filtering, deduplication, encoding."""
