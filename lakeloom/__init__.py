"""lakeloom: layered (bronze, silver, gold) retail analytics as plain Spark DataFrame jobs."""
