"""Code-graph, retrieval and session analytics as Spark jobs."""
