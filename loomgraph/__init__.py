"""Loomgraph: dependency-graph analytics on Spark DataFrames."""
