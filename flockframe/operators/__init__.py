"""DataFrame operators, one module per theme; ``species`` is always a grouping key."""
