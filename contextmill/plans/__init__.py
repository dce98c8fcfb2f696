"""End-to-end request plans and the query catalogue."""
