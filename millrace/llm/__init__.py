"""Training-data operators: deduplication, packing, formatting, scoring, filters and archives.

Nothing outside this subpackage imports it. ``registry`` holds the queries and their SQL.
"""
