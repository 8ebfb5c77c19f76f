"""Spark-native operators for verified synthetic data: ranking, populations, text, regression, storage."""
