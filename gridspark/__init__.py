"""Spark-native analytics for geospatial grids and vector features."""
