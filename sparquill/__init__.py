"""Spark-native analysis of source repositories and text corpora."""

__version__ = "0.1.0"
