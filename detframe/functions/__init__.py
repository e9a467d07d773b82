"""Column expressions; no function here starts a job or leaves the JVM."""
