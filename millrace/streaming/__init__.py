"""Snapshots fed by streams."""
