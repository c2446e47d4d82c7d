"""A PySpark-native engine for multilingual source retrieval."""
