"""Spark-native telemetry evidence analytics."""
