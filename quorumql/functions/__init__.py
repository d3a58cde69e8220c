"""Column functions. Everything here is built from built-in expressions; no Python runs per row."""
