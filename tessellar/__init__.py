"""Tensor-network analytics on Spark DataFrames."""
