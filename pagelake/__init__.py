"""pagelake: a PySpark-native engine for building, checking and rebuilding document corpora."""

__version__ = "0.1.0"
