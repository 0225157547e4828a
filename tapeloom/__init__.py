"""Market-microstructure analytics as Spark DataFrame transforms."""
