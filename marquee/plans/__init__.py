"""Plans: the query registry, its SQL oracles, and the one-run report."""
