"""Continuous ingestion of raw pull requests into the store."""
