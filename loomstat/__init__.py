"""Spark-native analytics and classical machine learning."""

__version__ = "0.1.0"
