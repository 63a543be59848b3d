"""Spark-first analytics for reproducible model evaluation."""
