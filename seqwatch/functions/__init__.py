"""Column-to-column expressions. All are built-in Spark functions and stay in generated code."""
