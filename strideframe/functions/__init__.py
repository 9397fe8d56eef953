"""Column-to-column expressions; everything here stays inside the JVM."""
