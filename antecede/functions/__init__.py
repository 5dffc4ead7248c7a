"""NumPy helpers that run inside grouped-map tasks."""
