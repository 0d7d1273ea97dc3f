"""Column expressions and metric aggregates."""
