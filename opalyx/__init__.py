"""Spark-native analytics over public-notice feeds and text corpora."""
