"""Spark-native preparation, validation, splitting and scoring of nested JSON annotations."""

__version__ = "0.1.0"
