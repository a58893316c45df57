"""Operators for preparing training text: language, quality, duplicates, packing, tokens, vectors, pages."""
