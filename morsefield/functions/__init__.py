"""Column functions and parameter checks."""
