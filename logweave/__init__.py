"""Spark-native engine for log evidence: parse, normalise, match, chunk, search and score."""
