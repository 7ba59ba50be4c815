"""Spark-native analytics for ordered market-style series."""
