"""Column functions: vectors and texts."""
