"""Hybrid search, ranking and corpus processing on Spark DataFrames."""
