"""Operators of a training-data pipeline: filters, deduplication, search, packing."""
