"""Structured Streaming twins of the usage operators."""
