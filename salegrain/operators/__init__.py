"""DataFrame operators: validation, lateness, aggregation, versioned state, reports."""
