"""Operators that prepare training text: quality, deduplication, mixing, tokens and media."""
