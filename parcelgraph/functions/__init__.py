"""Scalar functions as Spark column expressions."""
