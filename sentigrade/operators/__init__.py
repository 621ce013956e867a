"""DataFrame operators: joins, orderings, aggregates and statistics."""
