"""Structured Streaming jobs: stream scoring and session state."""
