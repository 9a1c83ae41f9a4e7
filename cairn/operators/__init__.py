"""Operators of the inventory engine."""
