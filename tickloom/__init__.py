"""Market time-series analytics as PySpark DataFrame and SQL plans."""
