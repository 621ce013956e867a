"""Column expressions: every function here is a native expression, no Python runs per row."""
