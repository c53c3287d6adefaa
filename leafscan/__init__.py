"""leafscan: document retrieval and evidence analytics as PySpark DataFrame jobs."""
