"""Resumable ingest."""
