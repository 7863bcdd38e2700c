"""Media-monitoring analytics as PySpark DataFrame jobs."""
