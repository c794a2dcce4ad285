"""A Spark-first analytics library for layered samples, points and rasters."""
