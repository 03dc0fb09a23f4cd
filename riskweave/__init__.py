"""A Spark-native text-risk decision engine."""
