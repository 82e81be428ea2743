"""A PySpark-native curation analytics engine."""
