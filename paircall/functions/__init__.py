"""Column expressions; everything here runs in the JVM."""
