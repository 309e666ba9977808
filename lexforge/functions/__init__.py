"""Column functions and row-wise functions."""
