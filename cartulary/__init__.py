"""Spark-native engine for crosswalking compliance-control catalogs."""
