"""Readers with explicit schemas and stand-in inputs built from the test tables."""
