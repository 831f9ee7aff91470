"""Operators on DataFrames: each takes and returns DataFrames, lazily where it can."""
