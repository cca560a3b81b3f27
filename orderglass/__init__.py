"""Spark-native sales and cash-flow reporting on large tables."""
