"""Operators for preparing training text: tokens, filters, deduplication and scoring."""
