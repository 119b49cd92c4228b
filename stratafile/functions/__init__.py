"""Column expressions: built-in Spark functions composed on the JVM side, and the few Arrow functions that need bytes."""
