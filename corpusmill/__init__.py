"""Spark-native corpus analytics."""
