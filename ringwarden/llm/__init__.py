"""Operators of a training-data pipeline: deduplication, scans, filters, mixing, packing."""
