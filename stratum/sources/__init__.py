"""Reading, writing and accounting for tables."""
