"""Spark-first market-data quality and analytics engine."""
