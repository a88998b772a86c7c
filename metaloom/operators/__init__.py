"""Operators on DataFrames of governance graphs, observations, snapshots and catalogs."""
