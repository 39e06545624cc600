"""A Spark-native operations analytics engine."""
