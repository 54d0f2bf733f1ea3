"""Data sources that Spark reads through spark.read.format(...)."""
