"""Fiber-network analytics on Spark DataFrames."""
