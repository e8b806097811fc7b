"""Planar overlay analytics on Spark DataFrames."""
