"""Species range and occurrence analytics as Spark DataFrame operators on long tables."""
