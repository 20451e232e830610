"""Typed document collections on Spark: mappings, strict ingest, versioned storage, full-text and exact search."""
