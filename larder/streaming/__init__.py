"""Structured Streaming forms of the time and state operators."""
