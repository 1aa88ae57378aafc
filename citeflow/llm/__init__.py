"""Operators for training-data pipelines: web archives, near duplicates, packing, filters, search and tokens."""
