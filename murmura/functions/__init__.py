"""Column functions: every one takes and returns a Column (or names), and runs in the JVM."""
