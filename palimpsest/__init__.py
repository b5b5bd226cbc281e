"""Versioned, content-addressed snapshot analytics on Spark DataFrames."""
