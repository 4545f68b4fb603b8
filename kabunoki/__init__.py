"""A Spark-native engine for cross-sectional equity analytics."""
