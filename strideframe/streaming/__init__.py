"""Structured Streaming forms of the bout, track-state and ingest operators."""
