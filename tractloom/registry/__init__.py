"""The queries that can be checked against the test tables."""
