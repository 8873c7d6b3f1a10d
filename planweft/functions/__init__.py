"""Scalar operators and aggregations of the plan language as Spark columns."""
