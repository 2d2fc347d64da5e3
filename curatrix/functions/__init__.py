"""Column expressions: each takes and returns columns and stays inside the JVM, but for those marked otherwise."""
