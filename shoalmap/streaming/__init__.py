"""Structured Streaming sink for partial results."""
