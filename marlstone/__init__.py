"""A Spark-native document retrieval and event analytics engine."""
