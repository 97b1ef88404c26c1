"""Column builders for box arithmetic and predicates."""
