"""Graph aggregates, pattern algebra, matching and pruning operators."""
