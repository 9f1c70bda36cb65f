"""Density-based clustering and its building blocks on Spark DataFrames."""
