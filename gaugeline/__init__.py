"""Spark-native analytics over inspection narratives: extract evidence, link it, count it."""

__version__ = "0.1.0"
