"""tidemark: a PySpark-native point-in-time analytics engine for two-outcome contests."""
