"""Demand estimation and pricing analytics over trip tables, as Spark DataFrame functions."""
