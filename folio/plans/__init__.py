"""Plan helpers (lineage cuts, prefix sums, components) and the query catalogue."""
