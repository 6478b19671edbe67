"""Operators of a training-data pipeline: privacy, mixing, deduplication, tokens, languages, search."""
