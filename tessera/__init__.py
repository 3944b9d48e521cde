"""Tensor-catalog analytics on Spark DataFrames."""
