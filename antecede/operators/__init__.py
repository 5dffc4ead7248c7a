"""DataFrame operators on long tables."""
