"""A PySpark-native engine for cited retrieval over document corpora."""
