"""Catalogs, readers and sinks."""
