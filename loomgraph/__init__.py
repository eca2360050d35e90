"""Hybrid retrieval and property-graph analytics on PySpark DataFrames."""
