"""Column expressions: text and keys, arrays and vectors, distributions."""
