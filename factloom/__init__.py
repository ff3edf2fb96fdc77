"""Spark-native analytics over temporal facts: DataFrame operators, sources and functions."""
