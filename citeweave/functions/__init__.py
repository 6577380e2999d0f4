"""Column-level building blocks (Column -> Column), all evaluated inside the JVM."""
