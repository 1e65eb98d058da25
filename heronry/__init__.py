"""Spark-native curation of large media and document collections."""
