"""Spark-native analytics for gridded terrain and hazard data."""
