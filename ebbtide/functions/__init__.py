"""Column-level helpers. Everything returns a Column and stays inside the JVM."""
