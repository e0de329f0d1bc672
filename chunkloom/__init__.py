"""Document chunking and corpus processing on Spark."""
