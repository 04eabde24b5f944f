"""Spark-native engine for coordination analysis, text similarity and annotation statistics."""
