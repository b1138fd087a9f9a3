"""Operators of training-data pipelines: search, dedup, filters, quality, packing, mixing, archives, privacy."""
