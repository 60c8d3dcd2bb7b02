"""Spark-native retrieval and item-quality analytics."""
