"""Column -> Column functions; everything here stays JVM-side."""
