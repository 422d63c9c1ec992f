"""Inputs: tables, the property graph made of them, and stores with tenants."""
