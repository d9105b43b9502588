"""Column builders: JVM-side expressions, no Python execution."""
