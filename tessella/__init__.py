"""A Spark-native engine for preparing and searching document corpora."""
