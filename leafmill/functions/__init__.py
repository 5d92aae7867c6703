"""Column functions and per-row text functions."""
