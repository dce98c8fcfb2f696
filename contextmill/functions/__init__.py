"""Column functions: every one of them builds a Catalyst expression."""
