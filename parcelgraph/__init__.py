"""Spark-native analytics over research-object metadata packages and large text corpora."""
