"""Spark-first analytics over filings and other document collections."""
