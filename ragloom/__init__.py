"""Spark-native retrieval evaluation and text-data engine."""

__version__ = "0.1.0"
