"""Spark-native analytics for large local-business directories."""
