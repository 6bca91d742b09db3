"""tessera: labelled code-graph and text analytics as Spark DataFrame jobs."""
