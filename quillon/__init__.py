"""quillon: a Spark-native engine for compressed vector search and its evaluation."""
