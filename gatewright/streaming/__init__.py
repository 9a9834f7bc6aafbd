"""Streams of examples and results."""
