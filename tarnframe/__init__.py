"""A PySpark-native engine for single-file SQL queries."""
