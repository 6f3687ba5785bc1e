"""Snapshot analytics on Spark: versioned, content-addressed data as DataFrames."""
