"""Streaming forms of the slice counts."""
