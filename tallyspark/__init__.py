"""Spark-native analytics over expense documents, and corpus preparation at scale."""
