"""Short-text topic analytics as Spark DataFrame jobs."""
