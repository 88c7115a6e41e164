"""Column expressions: scalar arithmetic, text, lexicons."""
