"""Operators for training-data pipelines: search, packing, scoring, tagging, archives and deduplication."""
