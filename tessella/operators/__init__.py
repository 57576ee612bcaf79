"""Operators on DataFrames: search merge, robots, cookies, documents, state."""
