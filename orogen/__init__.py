"""Spark-native terrain raster analytics."""
