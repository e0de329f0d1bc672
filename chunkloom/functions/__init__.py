"""Column expressions. All are built-in Spark expressions: no Python runs per row."""
