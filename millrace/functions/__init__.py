"""Column functions and running sums."""
