"""Hybrid retrieval, evidence and corpus processing on Spark DataFrames."""
