"""A Spark-first engine for checking converted documents against their sources."""
