"""Spark-native analytics over collections of legal text."""
