"""A Spark-native engine for matching the properties of one data model to another."""
