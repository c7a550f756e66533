"""Spark-native document retrieval, evidence and training-data operators."""
