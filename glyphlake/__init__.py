"""Spark-native engine for legacy font-encoded Bengali text and training corpora."""

__version__ = "0.1.0"
