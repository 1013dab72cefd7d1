"""Operators that prepare training text: deduplication, filtering, extraction and mixing.

Nothing else in ``lamella`` imports this subpackage.
"""
