"""A Spark-native engine for evidence graphs over captured records."""
