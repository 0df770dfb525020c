"""Operators of the read algebra and the write path: each takes DataFrames and returns a DataFrame."""
