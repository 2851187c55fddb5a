"""Spark-native engine for searching, verifying and evaluating document corpora."""
