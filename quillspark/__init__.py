"""A PySpark-native engine that checks citations in document collections."""
