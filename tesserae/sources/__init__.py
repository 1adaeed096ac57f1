"""Where chunks come from."""
