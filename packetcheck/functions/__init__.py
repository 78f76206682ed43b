"""Column expressions: normalising, coercing and classifying values."""
