"""Mining plans, comparisons and the query catalogue."""
