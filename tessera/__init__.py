"""Spark-native catalog curation, search and matching."""
