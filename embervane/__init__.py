"""Embervane: compressed-vector analytics on Spark DataFrames."""
