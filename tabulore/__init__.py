"""Spark-native data dictionaries: decode many formats, profile every column, render the result."""
