"""Incremental ingest of documents."""
