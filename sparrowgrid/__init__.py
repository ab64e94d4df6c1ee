"""A Spark-native catalog intelligence engine."""
