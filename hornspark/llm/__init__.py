"""Training-data operators: tokenisation, privacy, quality, near-duplicates, extraction.

Nothing outside this subpackage imports it.
"""
