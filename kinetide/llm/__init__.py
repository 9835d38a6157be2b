"""Operators for training-data pipelines: tokens, search, filters, duplicates and chat records."""
