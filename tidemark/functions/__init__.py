"""Column expressions (no shuffle, no Python in the row path)."""
