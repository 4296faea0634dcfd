"""Spark-first analytics over regulatory case records."""
