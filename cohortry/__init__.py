"""Population-scale clinical logic on Spark."""
