"""Spark-native analytics for imaging-derived time series."""
