"""Readers and writers of document folders, chunk tables and log tables."""
