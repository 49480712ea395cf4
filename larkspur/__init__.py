"""larkspur: a Spark-native engine for document retrieval and learning analytics."""
