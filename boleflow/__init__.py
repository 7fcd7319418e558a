"""Spark-native measurement of linear objects in large rasters."""
