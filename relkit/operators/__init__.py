"""Query operators: the builder, includes, grouping, windows, set operations, mutations."""
