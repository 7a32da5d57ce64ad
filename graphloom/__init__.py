"""Graphloom: a PySpark-native engine for evidence-backed knowledge graphs over document collections."""
