"""Streaming of the inventory engine."""
