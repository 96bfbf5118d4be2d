"""trovex: a PySpark-native engine for building and evaluating retrieval datasets."""

__version__ = "0.1.0"
