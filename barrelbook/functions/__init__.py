"""Column -> Column functions. All of them are built from JVM expressions."""
