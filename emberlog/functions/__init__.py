"""Column functions: routing, JSON records, order statistics."""
