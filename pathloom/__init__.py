"""Spark-native analytics over scenario time-series tables."""
