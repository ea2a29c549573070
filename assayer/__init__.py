"""Assayer: a Spark-native engine that checks documents against declared rules."""

__version__ = "0.1.0"
