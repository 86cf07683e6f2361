"""Spark-native analytics for per-entity time series, label rasters and text corpora."""
