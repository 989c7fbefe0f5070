"""Operators of a training-data pipeline: fixity, privacy, deduplication, quality, search, scoring, packing, coding."""
