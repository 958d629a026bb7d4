"""Operators for preparing training text: deduplication, filters, scans and packing.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
