"""Scans, loaders and ingest."""
