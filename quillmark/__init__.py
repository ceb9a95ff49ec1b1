"""Spark-native citation and evidence auditing engine."""

__version__ = "0.1.0"
