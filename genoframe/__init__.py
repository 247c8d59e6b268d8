"""genoframe: a PySpark-native engine for position-indexed sequence analytics."""

__version__ = "0.1.0"
