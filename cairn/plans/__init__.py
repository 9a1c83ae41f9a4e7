"""Plans of the inventory engine."""
