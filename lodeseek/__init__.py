"""Spark-first hybrid document search and data-processing engine."""
