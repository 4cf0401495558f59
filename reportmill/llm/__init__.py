"""Operators of a training-data pipeline: filtering, extraction, scoring, deduplication, encoding."""
