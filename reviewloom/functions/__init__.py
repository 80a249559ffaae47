"""Column expressions. All are row-local and stay inside the JVM."""
