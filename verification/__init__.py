"""Flight data derived from the test tables, and the queries checked on it."""
