"""Spark-native analytics for molecular and spatial tables."""
