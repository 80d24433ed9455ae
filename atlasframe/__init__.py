"""A PySpark-native engine for compact place-name databases."""

__version__ = "0.1.0"
