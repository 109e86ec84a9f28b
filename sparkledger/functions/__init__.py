"""Column functions and small numeric rules."""
