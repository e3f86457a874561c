"""Scalar, temporal and aggregate functions as Spark columns."""
