"""Operators for preparing training corpora: near-duplicates, filters, packing, encoding."""
