"""Incremental forms of the batch ingest."""
