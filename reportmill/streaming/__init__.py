"""Structured Streaming forms of the live feeds."""
