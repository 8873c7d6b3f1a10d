"""Relational plans, positional and typed, compiled to lazy Spark DataFrames."""
