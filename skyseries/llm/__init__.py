"""Operators for preparing training text: filters, near duplicates, tokens, packing, search, extraction."""
