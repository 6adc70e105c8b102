"""Operators for training-data corpora: filtering, deduplication, packing, tokens, formats and extraction."""
