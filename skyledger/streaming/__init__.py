"""Incremental loads that remember which files they have seen."""
