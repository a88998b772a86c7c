"""Metadata-governance analytics on Spark DataFrames."""
