"""Spark-native evaluation of retrieval-augmented answers."""
