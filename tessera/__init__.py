"""Spark-native operators for media-evidence tables and training-text corpora."""
