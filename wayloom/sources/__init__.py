"""Readers, writers and the test projections."""
