"""Structured Streaming forms of the landing operators."""
