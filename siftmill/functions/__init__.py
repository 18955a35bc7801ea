"""Column functions that stay inside the JVM unless stated otherwise."""
