"""Host-metrics analytics as Spark jobs."""
