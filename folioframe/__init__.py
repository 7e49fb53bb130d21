"""folioframe: a Spark-native engine for page-level document corpora."""
