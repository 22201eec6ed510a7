"""Column functions and the numeric kernel."""
