"""Whole plans: index build, search, ingest."""
