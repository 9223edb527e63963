"""Operators put together: ingest of a batch, quality control, the read API, bulk load."""
