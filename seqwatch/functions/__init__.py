"""Column functions, special functions and sequence recursions."""
