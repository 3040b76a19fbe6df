"""Structured Streaming: the table operators on unbounded input."""
