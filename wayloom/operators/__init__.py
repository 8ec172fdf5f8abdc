"""Operators over trips, flows, points of interest and graphs; each takes and returns DataFrames."""
