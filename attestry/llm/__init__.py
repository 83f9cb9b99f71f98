"""Operators for training corpora: dedup, filters, packing, salvage, PII.

Nothing outside this subpackage imports it.
"""
