"""Column expressions and UDFs."""
