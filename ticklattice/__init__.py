"""Market-data analytics as Spark DataFrame operators."""
