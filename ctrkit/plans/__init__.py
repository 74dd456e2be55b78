"""Stand-in inputs over the test tables and the query catalogue."""
