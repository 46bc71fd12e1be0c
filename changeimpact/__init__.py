"""Schema-change impact analytics over a query log, as PySpark DataFrame jobs."""
