"""Column functions: each takes and returns Columns, stays inside the JVM and never shuffles."""
