"""Hybrid lexical and vector retrieval on Spark DataFrames."""
