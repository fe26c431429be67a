"""A Spark-native engine for document similarity and classification over collections of pages."""

__version__ = "0.1.0"
