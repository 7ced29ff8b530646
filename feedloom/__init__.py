"""feedloom: a PySpark-native engine for a rolling feed of listings and for preparing its texts."""

__version__ = "0.1.0"
