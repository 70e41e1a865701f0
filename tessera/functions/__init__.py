"""Scalar Column functions (all JVM-side expressions) and fixed rule values."""
