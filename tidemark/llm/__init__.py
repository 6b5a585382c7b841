"""Operators of a training-data pipeline: extraction, scoring, deduplication, tokenising, formatting."""
