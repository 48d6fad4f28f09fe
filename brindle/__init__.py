"""Skew-aware text and graph analytics on Spark DataFrames."""
