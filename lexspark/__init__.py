"""Spark jobs for legal-document corpora: ingest, annotation, retrieval, similarity and usage analytics."""
