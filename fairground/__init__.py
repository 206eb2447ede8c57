"""Activity analytics as Spark DataFrame jobs."""
