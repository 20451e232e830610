"""Structured Streaming ingest of command streams."""
