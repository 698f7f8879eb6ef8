"""Operators put together for a caller."""
