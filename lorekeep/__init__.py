"""Lorekeep: a PySpark-native engine for knowledge records and large text corpora."""
