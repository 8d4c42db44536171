"""Spark-native tabular risk analytics: profiling, features, models, paired tests."""

__version__ = "0.1.0"
