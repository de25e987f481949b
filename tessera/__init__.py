"""Spark-first operators for sparse, multi-endpoint measurement tables."""
