"""A PySpark-native engine for vector similarity search and float64 column compression."""
