"""Operators on graphs and their tables; each takes and gives DataFrames."""
