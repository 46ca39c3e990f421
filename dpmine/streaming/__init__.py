"""Incremental scoring of arriving training-group files (Structured Streaming)."""
