"""Column -> Column expressions (native Spark functions only)."""
