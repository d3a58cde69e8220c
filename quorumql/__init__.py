"""Spark-native evaluation of generated SQL: profile tables, compare results, vote, score and report."""

__version__ = "0.1.0"
