"""Attestra: a PySpark-native engine for reconciling document fields with system-of-record rows."""

__version__ = "0.1.0"
