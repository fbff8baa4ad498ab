"""Blog-archive migration analytics as Spark DataFrame jobs."""
