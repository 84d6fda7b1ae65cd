"""A PySpark-native engine for searching and maintaining a property graph of code symbols."""

__version__ = "0.1.0"
