"""Column functions: each takes and gives Columns, so plans stay inside the JVM."""
