"""Operators for building training corpora: filtering, search, near duplicates, mixing, packing and scoring.

Nothing outside this package imports it, and it imports nothing of the claims engine.
"""
