"""Siltstone: a PySpark-native evidence-retrieval analytics engine."""
