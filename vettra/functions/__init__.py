"""Column expressions. Everything here is built-in Spark SQL; no Python runs per row."""
