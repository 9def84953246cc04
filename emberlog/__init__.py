"""Spark-native incident log analytics, and (in ``llm``) training-data operations."""
