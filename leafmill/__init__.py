"""Spark-native document analytics: ingestion, chunking, indexing, retrieval and corpus preparation."""

__version__ = "0.1.0"
