"""Spark-native ordered key-value analytics."""
