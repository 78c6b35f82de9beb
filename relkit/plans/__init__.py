"""Around queries: schemas and their validation, units of work, captured queries."""
