"""Spark-native operators for regulatory and policy text analytics."""
