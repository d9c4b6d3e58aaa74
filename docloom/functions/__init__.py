"""Column functions: every one takes and returns a Column and stays in the JVM."""
