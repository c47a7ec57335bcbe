"""Spark-native time-series and cross-sectional research engine."""
