"""A Spark-native engine for read overlaps, string graphs and corpus preparation."""
