"""Column expressions and fixed rule tables."""
