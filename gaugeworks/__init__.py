"""A Spark-native engine for signal measurement, profile comparison and gap ranking."""

__version__ = "0.1.0"
