"""Spark-native hybrid retrieval, ranking and record-quality engine."""
