"""evalloom: a PySpark-native engine for scripted data-evaluation workflows."""

__version__ = "0.1.0"
