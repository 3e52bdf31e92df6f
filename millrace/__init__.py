"""Machine-log episodes, retrieval and evaluation as Spark DataFrame jobs."""
