"""Spark-native topical search analytics and training-data operators."""
