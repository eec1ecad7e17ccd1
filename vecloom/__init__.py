"""vecloom: retrieval analytics over vectors, logs and texts, written as Spark jobs."""
