"""Spark-native code and document retrieval engine."""
