"""millrace: a Spark-native analytics engine."""
