"""wayframe: scheduled-transport analytics as Spark DataFrame jobs."""
