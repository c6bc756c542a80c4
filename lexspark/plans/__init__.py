"""Composed jobs: ingest, question answering, analytics report, document similarity."""
