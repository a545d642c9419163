"""Flight on-time analytics as plain Spark DataFrame jobs."""
