"""Operators for training-data pipelines: dedup, filters, tokens, archives."""
