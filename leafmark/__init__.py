"""leafmark: evidence retrieval, verification and evaluation as Spark jobs."""
