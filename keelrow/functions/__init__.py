"""Column expressions: names, types, defaults, text."""
