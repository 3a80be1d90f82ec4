"""Tidemark: a Spark-native engine for long-lived text memory and its analytics."""
