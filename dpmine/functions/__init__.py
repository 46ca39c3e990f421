"""Column-level functions (vectors, arrays, text); all JVM-side expressions."""
