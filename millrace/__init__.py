"""Spark-first preparation, splitting and evaluation of tabular data."""
