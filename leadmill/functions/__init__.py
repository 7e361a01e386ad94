"""Column -> Column building blocks; everything here stays in JVM expressions."""
