"""A PySpark-native engine that treats a corpus of source files as tables."""
