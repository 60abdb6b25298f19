"""A PySpark-native engine for ordered event logs and the state derived from them."""

__version__ = "0.1.0"
