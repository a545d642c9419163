"""Readers and writers: landing files, lookups, monthly tables."""
