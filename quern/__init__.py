"""Spark-native analytics for observational and scientific data."""
