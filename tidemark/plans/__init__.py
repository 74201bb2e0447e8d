"""Time chunks, the shared as-of state and feature sets."""
