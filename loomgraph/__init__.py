"""Document-graph analytics expressed as Spark jobs."""
