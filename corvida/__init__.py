"""PySpark-native engine for auditable binary-classification data work."""

__version__ = "0.1.0"
