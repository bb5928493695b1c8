"""The data products."""
