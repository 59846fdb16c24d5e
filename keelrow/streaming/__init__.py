"""Structured Streaming forms of the log and of the import."""
