"""Readers of archives, feeds and lists."""
