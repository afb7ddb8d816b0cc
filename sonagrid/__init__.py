"""Spark-native analytics over geo-located, time-stamped acoustic observations."""
