"""Reusable plan shapes and the query catalogue."""
