"""Vehicle-log analytics as Spark DataFrame jobs."""
