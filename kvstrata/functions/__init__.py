"""Column expressions: keys and values as bytes."""
