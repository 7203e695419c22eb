"""Relational operators of the analysis; each takes and returns DataFrames."""
