"""reviewloom: a PySpark-native engine for customer-review data."""

__version__ = "0.1.0"
