"""Operators over catalog DataFrames."""
