"""Continuous versions of operators, on Structured Streaming."""
