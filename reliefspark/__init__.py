"""Terrain analytics on Spark DataFrames."""
