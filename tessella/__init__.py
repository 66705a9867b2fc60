"""Temporal property-graph analytics on Spark DataFrames."""
