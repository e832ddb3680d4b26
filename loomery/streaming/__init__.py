"""Incremental processing hosted in Structured Streaming."""
