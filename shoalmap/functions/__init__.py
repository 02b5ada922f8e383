"""Column expressions: ids, metric names, numbers and nested records."""
