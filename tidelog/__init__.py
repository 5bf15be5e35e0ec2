"""Log and event analytics as Spark jobs."""
