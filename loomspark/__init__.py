"""loomspark: a Spark-native engine for preparing and analysing training data."""
