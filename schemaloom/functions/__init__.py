"""Column expressions: text, vectors and embedding."""
