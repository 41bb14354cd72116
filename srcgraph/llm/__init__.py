"""Operators of a training-data pipeline: quality, scoring, packing, duplicates, mixing, extraction."""
