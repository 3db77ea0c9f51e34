"""Kinweave: a PySpark-native record-linkage and corpus-processing engine."""
