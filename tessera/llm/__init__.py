"""Operators of a training-data pipeline: counting, extraction, deduplication, decontamination, search, packing."""
