"""loreweave: temporal knowledge-graph analytics and hybrid retrieval as Spark jobs."""
