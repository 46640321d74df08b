"""Registered queries (Spark callables + DuckDB oracle text) behind __spark_entry__."""
