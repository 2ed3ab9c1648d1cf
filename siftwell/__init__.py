"""A PySpark-native engine for report findings, their evaluation and their exports."""

__version__ = "0.1.0"
