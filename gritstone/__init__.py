"""Spark-native similarity, code-quality and baseline analytics."""
