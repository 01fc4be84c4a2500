"""copse: plot-level forest LiDAR analytics as Spark DataFrame operators."""
