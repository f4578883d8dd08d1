"""Spark-first engine for laboratory-report records and corpus preparation."""
