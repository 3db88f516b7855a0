"""Spark-native analytics for second-resolution physiological series."""

__version__ = "0.1.0"
