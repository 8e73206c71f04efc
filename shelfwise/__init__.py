"""Spark-native curation of large item catalogs."""

__version__ = "0.1.0"
