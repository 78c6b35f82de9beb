"""Column expressions: scalar functions, predicates and full-text search."""
