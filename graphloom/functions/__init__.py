"""Column functions and their word lists."""
