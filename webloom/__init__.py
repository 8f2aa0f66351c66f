"""Webloom: a PySpark-native engine for analysing web artifacts as tables."""
