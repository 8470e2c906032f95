"""Spark-first sales and distribution analytics."""
