"""Structured Streaming forms of the views over logs."""
