"""Queries: operators applied to the driver tables, and the same in SQL."""
