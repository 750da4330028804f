"""Spark-native analytics for citation-mapping data sets."""

__version__ = "0.1.0"
