"""Plans as data and as SQL."""
