"""Ingest of listing pages and details, in batches or from a stream."""
