"""End-to-end plans: the pipeline from files to chunks, its sinks, and the catalogue of test queries."""
