"""Annual-report and event analytics as Spark DataFrame jobs."""
