"""Column expressions; every one is built from Spark SQL built-ins."""
