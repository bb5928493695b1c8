"""Scans with explicit schemas, page extraction, sinks."""
