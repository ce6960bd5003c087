"""A Spark-native engine for large catalogues."""
