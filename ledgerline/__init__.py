"""Spark-native analytics over versioned, append-only file catalogs."""
