"""Spark-native lending and document analytics."""
