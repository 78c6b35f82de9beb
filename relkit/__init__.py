"""relkit: entities, a fluent query builder and mutations over Spark DataFrames."""
