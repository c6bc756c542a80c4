"""Structured Streaming forms of ingest, counts, health and the query log."""
