"""engramic: memory retrieval and lifecycle analytics as Spark DataFrame jobs."""
