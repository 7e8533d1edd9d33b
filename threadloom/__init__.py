"""Spark-native analytics over logs of conversations with software agents."""
