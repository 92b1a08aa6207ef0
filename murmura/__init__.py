"""A Spark-native engine for analytics over wide tables of measurements taken from ordered recordings."""
