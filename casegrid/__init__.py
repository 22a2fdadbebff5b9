"""casegrid: document-case validation analytics as Spark DataFrame jobs."""
