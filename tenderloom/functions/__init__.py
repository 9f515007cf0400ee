"""Column functions: text, numbers, identifiers."""
