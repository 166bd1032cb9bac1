"""Spatial cohort analytics on Spark DataFrames."""
