"""Operators of a training-data pipeline: extraction, archives, filters, duplicates, contamination, privacy, tokens."""
