"""Readers: raw files and responses to tables."""
