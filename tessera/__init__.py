"""Tessera: a PySpark-native engine for multi-source entity resolution."""
