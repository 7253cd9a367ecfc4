"""loam: a PySpark-native engine for measuring and maintaining text knowledge bases."""
