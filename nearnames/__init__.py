"""Spark-native confusable-name engine."""
