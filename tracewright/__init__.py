"""Tracewright: a PySpark-native engine for text provenance and workflow analytics."""

__version__ = "0.1.0"
