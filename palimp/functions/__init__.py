"""Column functions and the few functions that need Python."""
