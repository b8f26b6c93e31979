"""Structured Streaming twins of the continuous operators."""
