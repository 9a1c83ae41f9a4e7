"""Functions of the inventory engine."""
