"""Streams into the index."""
