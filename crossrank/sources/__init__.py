"""Readers: every one returns typed DataFrames with NULL for missing numbers."""
