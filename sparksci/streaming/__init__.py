"""Structured Streaming forms of operators whose state is small."""
