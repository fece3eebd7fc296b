"""Operators for training-data pipelines: dedup, filtering, tokenisation, packing."""
